"""Program text to typed programs. Parsing never fails a query: a row that can't be read gets a null program."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandset.functions.udf import arrow_udf, columnar_udf, once
from strandset.schema import JOIN, POINTER, PROGRAM, REF

#: A program as its text has it, evidence as pairs.
PLAIN = PROGRAM.replace(f"array<{REF}>", "array<array<int>>")
WRAPPED = r"(?s)<PROGRAM>\s*(\{.*?\})\s*</PROGRAM>"


def payload(text: Column) -> Column:
    """The JSON in the first program tags, else the whole trimmed text."""
    inner = F.when(F.contains(text, F.lit("</PROGRAM>")), F.regexp_extract(text, WRAPPED, 1)).otherwise("")
    return F.when(inner != "", inner).otherwise(F.trim(text))


def _pointer(item: dict) -> dict:
    return {
        "doc": int(item["doc"]), "sent": int(item["sent"]), "start": int(item.get("start", -1)), "end": int(item.get("end", -1)),
        "field": str(item.get("field", "sentence")), "quote": str(item.get("quote", "")),
    }


def read(text: str | None) -> dict | None:
    """A program as nested dictionaries, null for anything that isn't one."""
    try:
        found = json.loads(text)
        answer = found["answer"]
        if not isinstance(answer, dict):
            return None
        joins = [
            {"left": _pointer(j["left"]), "right_doc": int(j["right_doc"]), "right_field": str(j.get("right_field", "title")), "kind": str(j.get("kind", "equi"))}
            for j in found.get("joins", [])
        ]
        out = {
            "version": int(found.get("version", 1)), "mode": str(found.get("mode", "unknown")), "evidence": [{"doc": int(r[0]), "sent": int(r[1])} for r in found.get("evidence", [])], "joins": joins,
            "answer": {
                "op": str(answer["op"]), "pointer": _pointer(answer["pointer"]) if answer.get("pointer") else None, "value": str(answer.get("value", "")),
                "operands": [_pointer(p) for p in answer.get("operands", [])], "labels": [_pointer(p) for p in answer.get("labels", [])], "value_type": str(answer.get("value_type", "text")),
            },
        }
        dict(found.get("metadata", {}))
        points = [*[j["left"] for j in joins], *out["answer"]["operands"], *out["answer"]["labels"], *([out["answer"]["pointer"]] if out["answer"]["pointer"] else [])]
        numbers = [out["version"], *[n for r in out["evidence"] for n in r.values()], *[j["right_doc"] for j in joins], *[p[c] for p in points for c in ("doc", "sent", "start", "end")]]
        return out if -(2**31) <= min(numbers) and max(numbers) < 2**31 else None
    except (ValueError, KeyError, TypeError, IndexError, AttributeError, OverflowError, RecursionError):
        return None


def _arrow(ddl: str) -> pa.DataType:
    """The Arrow type of a schema's text, without a session."""
    if ddl.startswith("array<"):
        return pa.list_(_arrow(ddl[6:-1]))
    if not ddl.startswith("struct<"):
        return {"int": pa.int32(), "string": pa.string()}[ddl]
    fields, depth, part = [], 0, ""
    for c in ddl[7:-1] + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = part.partition(":")
            fields, part = [*fields, (name, _arrow(kind))], ""
        else:
            part += c
    return pa.struct(fields)


def _column(found: list, kind: pa.DataType) -> pa.Array:
    """Nested dictionaries as an Arrow array, built field by field. A null structure has null fields."""
    if pa.types.is_struct(kind):
        fields = [_column([None if x is None else x[f.name] for x in found], f.type) for f in kind]
        return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pa.array([x is None for x in found], pa.bool_()))
    if pa.types.is_list(kind):
        ends = np.cumsum([0 if x is None else len(x) for x in found], dtype=np.int32)
        offsets = pa.array(np.concatenate([np.zeros(1, np.int32), ends]), pa.int32())
        return pa.ListArray.from_arrays(offsets, _column([y for x in found if x for y in x], kind.value_type), mask=pa.array([x is None for x in found], pa.bool_()))
    return pa.array(found, kind)


@columnar_udf(f"struct<ok:boolean,program:{PROGRAM}>")
def _read(texts: pa.Array, typed: pa.Array) -> pa.Array:
    """Programs of the texts that aren't typed yet. The others come along because Spark sends ahead what the pipe holds, and keeps the rows of what it sent: nulls
    in their place would let all rows of a task wait here."""
    kind = _arrow(PROGRAM)
    if typed.true_count == len(texts):
        programs = pa.nulls(len(texts), kind)
    else:
        programs = _column([None if done else read(t) for t, done in zip(texts.to_pylist(), typed.to_pylist())], kind)
    return pa.StructArray.from_arrays([programs.is_valid(), programs], names=["ok", "program"])


@once
def _typed() -> tuple[Column, Column]:
    """(whether ``__plain`` read from ``__payload`` is all that ``read`` would see in it, the program that ``read`` gives then).

    Written again, in the order of the schema or of the names, ``__plain`` must give the very text: then no field is unknown, doubled, null or of another type.
    What ``read`` asks for besides is looked at here."""
    p, text = F.col("__plain"), F.col("__payload")
    answer = p["answer"]
    kind = T.StructType.fromDDL(f"program {PLAIN}")["program"].dataType
    again = lambda x: F.to_json(x, {"ignoreNullFields": "true"})  # noqa: E731 - without options the optimizer takes to_json of from_json for the text itself
    same = F.when(text.startswith('{"answer"'), again(_by_name(p, kind))).otherwise(again(p)) == text
    placed = lambda x: x["doc"].isNotNull() & x["sent"].isNotNull()
    every = lambda xs, ok: xs.isNull() | F.forall(xs, ok)
    asked = (
        answer["op"].isNotNull() & (answer["pointer"].isNull() | placed(answer["pointer"])) & every(answer["operands"], placed) & every(answer["labels"], placed)
        & every(p["joins"], lambda j: placed(j["left"]) & j["right_doc"].isNotNull()) & every(p["evidence"], lambda r: F.size(r) >= 2)
    )
    or_ = lambda x, value: F.coalesce(x, F.lit(value))

    def point(x):
        return F.struct(
            x["doc"].alias("doc"), x["sent"].alias("sent"), or_(x["start"], -1).alias("start"), or_(x["end"], -1).alias("end"), or_(x["field"], "sentence").alias("field"), or_(x["quote"], "").alias("quote")
        )

    listed = lambda xs, make, of: F.coalesce(F.transform(xs, make), F.array().cast(f"array<{of}>"))
    typed = F.struct(
        or_(p["version"], 1).alias("version"), or_(p["mode"], "unknown").alias("mode"), listed(p["evidence"], lambda r: F.struct(r[0].alias("doc"), r[1].alias("sent")), REF).alias("evidence"),
        listed(p["joins"], lambda j: F.struct(point(j["left"]).alias("left"), j["right_doc"].alias("right_doc"), or_(j["right_field"], "title").alias("right_field"), or_(j["kind"], "equi").alias("kind")), JOIN).alias("joins"),
        F.struct(
            answer["op"].alias("op"), F.when(answer["pointer"].isNotNull(), point(answer["pointer"])).alias("pointer"), or_(answer["value"], "").alias("value"),
            listed(answer["operands"], point, POINTER).alias("operands"), listed(answer["labels"], point, POINTER).alias("labels"), or_(answer["value_type"], "text").alias("value_type"),
        ).alias("answer"),
    )
    return F.coalesce(~F.contains(text, F.lit("null")) & same & asked, F.lit(False)), typed


def parsed(rows: DataFrame, text: str = "output") -> DataFrame:
    """Adds ``program`` (null where ``parse_error``). Texts that Spark's JSON reader gives back unchanged are typed in the JVM, the others go through ``read``."""
    plain, typed = _typed()
    rows = rows.withColumn("__payload", payload(F.col(text))).withColumn("__plain", F.from_json("__payload", PLAIN)).withColumn("__same", plain)
    rows = rows.withColumn("__read", _read("__payload", "__same"))
    rows = rows.withColumns({"program": F.when(F.col("__same"), typed).when(F.col("__read.ok"), F.col("__read.program")), "parse_error": ~F.col("__same") & ~F.col("__read.ok")})
    return rows.drop("__payload", "__plain", "__same", "__read")


def wrapped_answer(text: Column) -> Column:
    """The trimmed text in the first answer tags, null without them."""
    return F.when(text.rlike(r"(?s)<ANSWER>.*?</ANSWER>"), F.regexp_extract(text, r"(?s)<ANSWER>\s*(.*?)\s*</ANSWER>", 1))


@arrow_udf("struct<ok:boolean,answer:string,evidence:array<struct<doc:int,sent:int>>>")
def citation(texts: pd.Series) -> pd.DataFrame:
    """Citation outputs, read strictly: a string answer and pairs of whole numbers."""

    def one(text):
        m = re.search(r"<CITATION>\s*(\{.*?\})\s*</CITATION>", text or "", re.S)
        try:
            found = json.loads(m[1] if m else (text or "").strip())
            pairs = found["evidence"]
            if not isinstance(found["answer"], str) or not isinstance(pairs, list):
                return False, None, None
            if any(not isinstance(p, list) or len(p) != 2 or any(type(x) is not int for x in p) for p in pairs):
                return False, None, None
            return True, found["answer"], [{"doc": d, "sent": s} for d, s in pairs]
        except (ValueError, KeyError, TypeError):
            return False, None, None

    return pd.DataFrame([one(t) for t in texts], columns=["ok", "answer", "evidence"])


@arrow_udf("string")
def citation_answer(texts: pd.Series) -> pd.Series:
    """The answer of a citation output as text, read leniently: nothing else of it is looked at."""

    def one(text):
        m = re.search(r"<CITATION>\s*(\{.*?\})\s*</CITATION>", text or "", re.S)
        try:
            return str(json.loads(m[1] if m else (text or "").strip())["answer"])
        except (ValueError, KeyError, TypeError):
            return None

    return texts.map(one)


def rendered(program: Column) -> Column:
    """Compact JSON with sorted keys; offsets go where a quote binds late."""
    late = lambda p: F.when(p["quote"] != "", p.withField("start", F.lit(None).cast("int")).withField("end", F.lit(None).cast("int"))).otherwise(p)
    order = lambda p: F.struct(*[p[c].alias(c) for c in ("doc", "end", "field", "quote", "sent", "start")])
    point = lambda p: order(late(p))
    a = program["answer"]
    answer = F.struct(
        F.transform(a["labels"], point).alias("labels"), a["op"].alias("op"), F.transform(a["operands"], point).alias("operands"),
        F.when(a["pointer"].isNotNull(), point(a["pointer"])).alias("pointer"), a["value"].alias("value"), a["value_type"].alias("value_type"),
    )
    joins = F.transform(program["joins"], lambda j: F.struct(j["kind"].alias("kind"), point(j["left"]).alias("left"), j["right_doc"].alias("right_doc"), j["right_field"].alias("right_field")))
    evidence = F.transform(program["evidence"], lambda r: F.array(r["doc"], r["sent"]))
    return F.to_json(F.struct(answer.alias("answer"), evidence.alias("evidence"), joins.alias("joins"), program["mode"].alias("mode"), program["version"].alias("version")))


def _by_name(column: Column, kind: T.DataType) -> Column:
    """``column`` with the fields of all its structures in the order of their names."""
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_by_name(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(column.isNotNull(), fields)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(column, lambda x: _by_name(x, kind.elementType))
    return column


#: Control characters that Spark writes with capital hexadecimal digits.
CAPITAL = ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F")


def canonical_json(column: Column, kind: T.DataType) -> Column:
    """Compact JSON with sorted keys, nulls written out, as Python's json gives it without escaping other scripts; the order of a schema's fields doesn't matter."""
    text = F.to_json(_by_name(column, kind), {"ignoreNullFields": "false"})
    small = text
    for code in CAPITAL:  # not after an escaped backslash
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
    return F.when(F.contains(text, F.lit(r"\u00")), small).otherwise(text)


@once
def canonical_program(program: str = "program") -> Column:
    """A program's canonical JSON: evidence as pairs, keys sorted, whatever else stood in its text left out."""
    p = F.col(program)
    kind = T.StructType.fromDDL(f"program {PROGRAM}")["program"].dataType
    pairs = T.StructType([T.StructField(f.name, T.ArrayType(T.ArrayType(T.IntegerType())) if f.name == "evidence" else f.dataType) for f in kind.fields])
    return canonical_json(F.when(p.isNotNull(), p.withField("evidence", F.transform(p["evidence"], lambda r: F.array(r["doc"], r["sent"])))), pairs)


def program_digest(program: str = "program") -> Column:
    """Digest of the canonical JSON, which any other reader of the same program gets as well."""
    return F.sha2(canonical_program(program).cast("binary"), 256)
