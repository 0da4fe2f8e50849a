"""Types of contexts, programs and snapshots."""

REF = "struct<doc:int,sent:int>"
POINTER = "struct<doc:int,sent:int,start:int,end:int,field:string,quote:string>"
JOIN = f"struct<left:{POINTER},right_doc:int,right_field:string,kind:string>"
ANSWER = f"struct<op:string,pointer:{POINTER},value:string,operands:array<{POINTER}>,labels:array<{POINTER}>,value_type:string>"
PROGRAM = f"struct<version:int,mode:string,evidence:array<{REF}>,joins:array<{JOIN}>,answer:{ANSWER}>"
DOCUMENTS = "array<struct<doc:int,title:string,sentences:array<string>>>"
CONTEXT = (
    f"dataset string, qid string, split string, question string, documents {DOCUMENTS}, answers array<string>, support array<{REF}>, question_type string, "
    "decomposition array<struct<step_id:int,question:string,answer:string,support_doc:int>>, evidences array<array<string>>, support_complete boolean, support_expected int"
)
CELL = "struct<field:string,doc:int,sent:int,sha256:string>"
#: What serving may read of a context; all other columns are supervision.
PUBLIC = ("dataset", "qid", "split", "question", "documents")
