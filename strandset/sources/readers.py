"""Question-answering sets as contexts, stored predictions, run manifests and report files."""

from __future__ import annotations

import hashlib
import json
import os

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.functions.text import casefold_all, clean, clean_all, split_sentences
from strandset.functions.udf import arrow_udf
from strandset.schema import CONTEXT, DOCUMENTS, PUBLIC, REF

#: Columns that hold or give away answers; serving must not see them.
SUPERVISION = (
    "answer", "answers", "support", "supporting_facts", "is_supporting", "evidences", "decomposition", "question_decomposition", "answer_aliases", "support_complete", "support_expected", "gold",
)

CONTEXT_STRUCT = "struct<title:array<string>,sentences:array<array<string>>>"
FACTS_STRUCT = "struct<title:array<string>,sent_id:array<int>>"


def source_files(dataset: str, root: str, split: str, variant: str | None = None) -> str:
    """Glob of a split; dev and validation are one, a variant belongs to hotpotqa only."""
    if variant and dataset != "hotpotqa":
        raise ValueError(f"{dataset} has no variants")
    names = "{dev,validation}" if split in ("dev", "validation") else split
    folder = f"{root}/{dataset}" + (f"/{variant}" if variant else "/distractor" if dataset == "hotpotqa" else "")
    return f"{folder}/{names}*.{'jsonl' if dataset == 'musique' else 'parquet'}"


@arrow_udf("array<array<string>>")
def _clean_nested(lists: pd.Series) -> pd.Series:
    from strandset.functions.text import tidy

    return lists.map(lambda rows: None if rows is None else [[tidy(x) for x in r] if r is not None else [] for r in rows])


def _documents(titles: Column, sentences: Column) -> Column:
    return F.zip_with(F.zip_with(titles, F.sequence(F.lit(0), F.greatest(F.size(titles) - 1, F.lit(0))), lambda t, i: F.struct(i.alias("i"), t.alias("t"))), sentences, lambda a, s: F.struct(
        a["i"].cast("int").alias("doc"), a["t"].alias("title"), F.coalesce(s, F.array().cast("array<string>")).alias("sentences")
    )).cast(DOCUMENTS)


def _supported(rows: DataFrame) -> DataFrame:
    """Adds documents, support, support_complete and support_expected from __titles, __sentences, __facts (title, sent)."""
    rows = rows.withColumns({"__titles": clean_all("__titles"), "__sentences": _clean_nested("__sentences"), "__names": clean_all(F.transform("__facts", lambda f: f["title"]))})
    rows = rows.withColumns({"documents": _documents(F.col("__titles"), F.col("__sentences"))})
    rows = rows.withColumns({"__folded": casefold_all("__titles"), "__asked": casefold_all("__names")})
    folded = F.col("__folded")
    at = lambda name: F.size(folded) - F.array_position(F.reverse(folded), name).cast("int")  # the last document of a title counts
    pairs = F.zip_with("__asked", "__facts", lambda n, f: F.struct(n.alias("t"), f["sent"].cast("int").alias("s")))
    known = F.filter(F.zip_with("__asked", "__facts", lambda n, f: F.struct(F.when(F.array_contains(folded, n), at(n)).alias("doc"), f["sent"].cast("int").alias("sent"))), lambda r: r["doc"].isNotNull())
    support, expected = F.array_distinct(known), F.size(F.array_distinct(pairs))
    return rows.withColumns({"support": support.cast(f"array<{REF}>"), "support_expected": expected, "support_complete": F.size(support) == expected})


def _finished(rows: DataFrame, dataset: str, split: str) -> DataFrame:
    empty = {"decomposition": "array<struct<step_id:int,question:string,answer:string,support_doc:int>>", "evidences": "array<array<string>>"}
    for name, kind in empty.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.array().cast(kind))
    rows = rows.withColumns({"dataset": F.lit(dataset), "split": F.lit(split)})
    return rows.select(*[c.split(" ")[0] for c in CONTEXT.split(", ")])


def _answers(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"__answer": clean("answer"), "question": clean("question"), "__type": clean("type")})
    return rows.withColumns({"answers": F.filter(F.array("__answer"), lambda a: a != ""), "question_type": F.when(F.col("__type") == "", "unknown").otherwise(F.col("__type"))})


def hotpot(raw: DataFrame, split: str = "dev") -> DataFrame:
    """Contexts of rows (id, question, answer, type, context, supporting_facts)."""
    facts = F.coalesce(F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("sent")), F.array().cast("array<struct<title:string,sent:int>>"))
    rows = raw.withColumns({"qid": F.col("id").cast("string"), "__titles": F.col("context.title"), "__sentences": F.col("context.sentences"), "__facts": facts.cast("array<struct<title:string,sent:int>>")})
    return _finished(_supported(_answers(rows)), "hotpotqa", split)


def wiki2(raw: DataFrame, split: str = "dev") -> DataFrame:
    """Contexts of rows whose context, supporting_facts and evidences are JSON texts (lists or objects) or structures."""
    rows = raw.withColumn("qid", F.coalesce(*[F.col(c).cast("string") for c in ("_id", "id") if c in raw.columns]))
    if dict(raw.dtypes)["context"] == "string":
        pairs = F.from_json("context", "array<array<string>>")
        as_lists = F.transform(pairs, lambda p: F.from_json(F.get(p, F.lit(1)), "array<string>"))
        whole = F.from_json("context", CONTEXT_STRUCT)
        is_list = F.ltrim("context").startswith("[")
        rows = rows.withColumns({"__titles": F.when(is_list, F.transform(pairs, lambda p: F.get(p, F.lit(0)))).otherwise(whole["title"]), "__sentences": F.when(is_list, as_lists).otherwise(whole["sentences"])})
    else:
        rows = rows.withColumns({"__titles": F.col("context.title"), "__sentences": F.col("context.sentences")})
    kind = "array<struct<title:string,sent:int>>"
    if dict(raw.dtypes)["supporting_facts"] == "string":
        listed = F.transform(F.from_json("supporting_facts", "array<array<string>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("title"), F.get(p, F.lit(1)).try_cast("int").alias("sent")))
        whole = F.from_json("supporting_facts", FACTS_STRUCT)
        zipped = F.zip_with(whole["title"], whole["sent_id"], lambda a, b: F.struct(a.alias("title"), b.alias("sent")))
        facts = F.when(F.ltrim("supporting_facts").startswith("["), listed).otherwise(zipped)
    else:
        facts = F.zip_with("supporting_facts.title", "supporting_facts.sent_id", lambda a, b: F.struct(a.alias("title"), b.cast("int").alias("sent")))
    rows = rows.withColumn("__facts", F.coalesce(facts, F.array().cast(kind)).cast(kind))
    triples = F.lit(None).cast("array<array<string>>") if "evidences" not in raw.columns else F.from_json("evidences", "array<array<string>>") if dict(raw.dtypes)["evidences"] == "string" else F.col("evidences")
    rows = rows.withColumn("evidences", _clean_nested(F.coalesce(F.transform(triples, lambda x: F.slice(x, 1, 3)), F.array().cast("array<array<string>>"))))
    return _finished(_supported(_answers(rows)), "2wiki", split)


def musique(raw: DataFrame, split: str = "dev") -> DataFrame:
    """Contexts of rows (id, question, answer, answer_aliases, paragraphs, question_decomposition): paragraphs by idx, cut into
    sentences; all sentences of supporting ones are support."""
    ordered = F.array_sort(F.transform("paragraphs", lambda p: F.struct(p["idx"].alias("idx"), p["title"].alias("title"), p["paragraph_text"].alias("text"), F.coalesce(p["is_supporting"], F.lit(False)).alias("ok"))))
    rows = raw.withColumn("__p", ordered).withColumns({"qid": F.col("id").cast("string"), "question": clean("question")})
    rows = rows.withColumns({"__titles": clean_all(F.transform("__p", lambda p: p["title"])), "__texts": clean_all(F.transform("__p", lambda p: p["text"]))})
    rows = rows.withColumn("documents", _documents(F.col("__titles"), F.transform("__texts", split_sentences)))
    refs = F.flatten(F.transform("documents", lambda d, i: F.when(F.get(F.col("__p"), i)["ok"], F.transform(d["sentences"], lambda _, s: F.struct(d["doc"].alias("doc"), s.alias("sent")))).otherwise(F.array().cast(f"array<{REF}>"))))
    place = F.transform("__p", lambda p: p["idx"])
    steps = F.coalesce(F.col("question_decomposition"), F.array())
    rows = rows.withColumns({"__q": clean_all(F.transform(steps, lambda s: s["question"])), "__a": clean_all(F.transform(steps, lambda s: s["answer"]))})
    found = lambda i: F.nullif(F.array_position(place, F.get(steps, i)["paragraph_support_idx"]), F.lit(0)).cast("int") - 1
    steps_out = F.transform("__q", lambda q, i: F.struct(i.alias("step_id"), q.alias("question"), F.get(F.col("__a"), i).alias("answer"), found(i).alias("support_doc")))
    alias = F.col("answer_aliases") if "answer_aliases" in raw.columns else F.array().cast("array<string>")
    rows = rows.withColumn("__all", clean_all(F.concat(F.array("answer"), F.coalesce(alias, F.array().cast("array<string>")))))
    hops = F.when(F.size("__q") > 0, F.size("__q")).otherwise(F.size(F.filter("__p", lambda p: p["ok"])))
    rows = rows.withColumns(
        {
            "support": F.array_distinct(refs).cast(f"array<{REF}>"), "decomposition": steps_out, "answers": F.array_distinct(F.filter("__all", lambda a: a != "")), "question_type": F.concat(F.lit("hops="), hops),
            "support_complete": F.lit(True),
        }
    )
    return _finished(rows.withColumn("support_expected", F.size("support")), "musique", split)


READERS = {"hotpotqa": hotpot, "2wiki": wiki2, "musique": musique}


def file_order() -> Column:
    """Where a row stands in its files: file, place of its split, place in the split (a split is read by one task, in order)."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))


def load_contexts(spark: SparkSession, dataset: str, root: str, split: str, variant: str | None = None, limit: int | None = None) -> DataFrame:
    """Contexts of a split; ``limit``: only the first rows in the order of files and lines."""
    path = source_files(dataset, root, split, variant)
    raw = spark.read.json(path) if dataset == "musique" else spark.read.parquet(path)
    if limit is not None:
        raw = raw.withColumn("__order", file_order()).orderBy("__order").limit(limit).drop("__order")
    return READERS[dataset](raw, split)


def raw_counts(spark: SparkSession, root: str, split: str, datasets: tuple[str, ...] = ("hotpotqa", "2wiki", "musique")) -> DataFrame:
    """(dataset, rows) of the source files."""
    out = None
    for dataset in datasets:
        path = source_files(dataset, root, split)
        one = (spark.read.json(path) if dataset == "musique" else spark.read.parquet(path)).agg(F.lit(dataset).alias("dataset"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def public(contexts: DataFrame) -> DataFrame:
    """What serving may read."""
    return contexts.select(*PUBLIC)


def _told(name: str) -> bool:
    return name.casefold() in SUPERVISION or name.casefold().startswith("gold")


def assert_public(rows: DataFrame, *json_columns: str) -> None:
    """Raises when a column or a nested field, in any letter case, is supervision or starts with gold, or when a JSON text in
    ``json_columns`` has such a key at any depth."""

    def walk(kind, path):
        for f in getattr(kind, "fields", []):
            if _told(f.name):
                raise ValueError(f"supervision in {'.'.join([*path, f.name])}")
            walk(f.dataType, [*path, f.name])
        for inner in ("elementType", "valueType"):
            if hasattr(kind, inner):
                walk(getattr(kind, inner), path)

    walk(rows.schema, [])
    for name in json_columns:
        keys = F.explode(F.regexp_extract_all(F.col(name), F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), 1))
        for (key,) in rows.select(keys.alias("key")).distinct().where(F.lower("key").isin(*SUPERVISION) | F.lower("key").startswith("gold")).limit(1).collect():
            raise ValueError(f"supervision in {name}: {key}")


PREDICTION = (
    "id string, dataset string, output string, finish_reason string, generated_tokens int, program string, "
    "candidates array<struct<output:string,finish_reason:string,generated_tokens:int,average_logprob:double,ranker_score:double,meta_ranker_score:double>>"
)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Stored predictions with ``line``, their place in the order of files and lines; a torn last line is dropped; a program object wins
    over the output text, a program text counts only where there is no output."""
    lines = spark.read.text(path).withColumn("line", file_order()).where("trim(value) != ''")
    rows = lines.withColumn("x", F.from_json("value", PREDICTION)).where("x.id is not null").select("x.*", "line", "value")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.program", "variant"))
    given = F.when(F.col("program").startswith("{"), F.when(kind.startswith("OBJECT"), F.col("program")))
    return rows.withColumn("output", F.coalesce(given, "output", "program")).drop("program", "value")


def file_digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


def check_manifest(path: str, wanted: dict, has_output: bool) -> None:
    """Writes a run's manifest, or refuses to go on with outputs of another one or of none."""
    if os.path.exists(path):
        with open(path) as f:
            if json.load(f) != wanted:
                raise ValueError(f"{path} is of another run")
    elif has_output:
        raise ValueError(f"outputs without {path}")
    else:
        write_report(wanted, path)


def write_report(report: dict, path: str) -> None:
    """Sorted, indented JSON, put in place at once."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(f"{path}.tmp", path)


