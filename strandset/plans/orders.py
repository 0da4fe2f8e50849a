"""Contexts and programs made from the star schema: what a program answers must equal a plain relational join.

Each order becomes a question over six titled documents: the order, its customer, the customer's nation, and the same for
the order with the next key. Twelve kinds of programs (order key modulo 12) cover the answer operators and the ways to fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.functions.udf import once
from strandset.operators.program import parsed
from strandset.schema import DOCUMENTS, REF

KINDS = ("copy", "composition", "argmin", "argmax", "equal", "common", "bool", "literal", "no_anchor", "disconnected", "uncited", "unparsed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(name: Column) -> Column:
    """Nation names with two digits, so that none is part of another."""
    return F.regexp_replace(name, r"_(\d)$", "_0$1")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as (k, customer, at, date, status); ``at`` is the key of the customer's nation."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(F.col("o_orderkey").alias("k"), F.col("c_name").alias("customer"), F.col("c_nationkey").alias("at"), F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status"))


def told(spark: SparkSession, sf_dir: str, rows: DataFrame, s: str = "") -> DataFrame:
    """Rows of ``placed`` with title, nation, region and day in place of at and date; ``s`` ends the names of all columns."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("__n"), padded(F.col("n_name")).alias(f"nation{s}"), F.col("r_name").alias(f"region{s}"))
    title = F.concat(F.lit("Order#"), F.lpad(F.col(f"k{s}").cast("string"), 9, "0"))
    rows = rows.join(places, F.col(f"at{s}") == F.col("__n"), "left").withColumns({f"title{s}": title, f"day{s}": F.date_format(f"date{s}", "d MMMM yyyy")})
    return rows.drop("__n", f"at{s}", f"date{s}")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, title, customer, nation, region, day, status) of each order."""
    return told(spark, sf_dir, placed(spark, sf_dir)).select("k", "title", "customer", "nation", "region", "day", "status")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its kind, its facts and those of the order with the next key. Rows move before their texts are made."""
    one = placed(spark, sf_dir)
    two = one.select(*[F.col(c).alias(f"{c}2") for c in one.columns])
    # as many tasks as the session asks for: Spark would join tasks by the few bytes that move, but what follows makes far more of each row
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = one.repartition(n, F.col("k") + 1).join(two.repartition(n, "k2"), F.col("k2") == F.col("k") + 1, "left")
    return told(spark, sf_dir, told(spark, sf_dir, rows), "2").drop("k2").withColumn("kind", context_columns()[0])


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts with the key, its kind and the names that programs quote."""
    return with_context(pairs(spark, sf_dir))


def with_context(rows: DataFrame) -> DataFrame:
    """Adds the columns of a context to rows of ``pairs``. Where programs are read too, they are read before, so that rows wait for the reader without their documents."""
    return rows.withColumns(context_columns()[1])


@once
def context_columns() -> tuple[Column, dict[str, Column]]:
    """The kind of a program by its key, and the columns of a context beside its facts."""
    said = lambda *parts: F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])

    def documents(s: str, at: int) -> list[Column]:
        doc = lambda i, title, *sentences: F.struct(F.lit(at + i).alias("doc"), F.col(title + s).alias("title"), F.array(*sentences).alias("sentences"))
        return [
            doc(0, "title", said(f"$title{s}", " was placed by ", f"$customer{s}", "."), said("It was ordered on ", f"$day{s}", "."), said("Its status is ", f"$status{s}", ".")),
            doc(1, "customer", said(f"$customer{s}", " is based in ", f"$nation{s}", ".")),
            doc(2, "nation", said(f"$nation{s}", " belongs to ", f"$region{s}", ".")),
        ]

    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("k") % 12).cast("int"))
    truth = (
        F.when(F.col("kind") == "composition", F.col("region"))
        .when(F.col("kind") == "equal", F.when(F.col("k") % 24 == 4, "neither").when(F.col("nation") == F.col("nation2"), "yes").otherwise("no"))
        .when(F.col("kind") == "bool", "yes")
        .otherwise(F.col("nation"))
    )
    refs = F.array(F.struct(F.lit(0).alias("doc"), F.lit(0).alias("sent")), F.struct(F.lit(1).alias("doc"), F.lit(0).alias("sent"))).cast(f"array<{REF}>")
    every = F.when(F.col("title2").isNull(), F.array(*documents("", 0))).otherwise(F.array(*documents("", 0), *documents("2", 3)))
    return (
        kind,
        {
            "dataset": F.lit("orders"), "qid": F.col("k").cast("string"), "question": said("Which nation is the customer of ", "$title", " based in?"), "documents": every.cast(DOCUMENTS),
            "answers": F.array(truth), "support": refs, "support_complete": F.lit(True),
        },
    )


def outputs(rows: DataFrame, kind: Column = F.col) -> DataFrame:
    """Adds output: the program text of the row's kind."""
    kind = F.col("kind") if kind is F.col else kind
    texts = program_texts()
    text = F.coalesce(*[F.when(kind == k, v) for k, v in texts.items()])
    wrapped = F.when(F.col("k") % 2 == 0, F.concat(F.lit("Plan: <PROGRAM> "), text, F.lit(" </PROGRAM>"))).otherwise(text)
    return rows.withColumn("output", F.when(kind == "unparsed", text).otherwise(wrapped))


@once
def program_texts() -> dict[str, Column]:
    """The program of each kind over the columns of a context."""
    point = lambda doc, sent, quote, field="sentence": F.struct(F.lit(doc).alias("doc"), F.lit(sent).alias("sent"), F.lit(field).alias("field"), F.col(quote).alias("quote"))
    join = lambda left, right, how="equi": F.struct(left.alias("left"), F.lit(right).alias("right_doc"), F.lit("title").alias("right_field"), F.lit(how).alias("kind"))
    ask, to_customer, to_nation = join(point(-1, -1, "title", "question"), 0, "query"), join(point(0, 0, "customer"), 1), join(point(1, 0, "nation"), 2)
    refs = lambda *pairs: F.array(*[F.array(F.lit(d), F.lit(s)) for d, s in pairs])
    none = F.array().cast("array<struct<doc:int,sent:int,field:string,quote:string>>")
    nothing = F.lit(None).cast("struct<doc:int,sent:int,field:string,quote:string>")

    def answer(op, pointer=nothing, value="", operands=none, labels=none):
        return F.struct(F.lit(op).alias("op"), pointer.alias("pointer"), F.lit(value).alias("value"), operands.alias("operands"), labels.alias("labels"))

    def program(mode, evidence, joins, reply):
        return F.to_json(F.struct(F.lit(1).alias("version"), F.lit(mode).alias("mode"), evidence.alias("evidence"), joins.alias("joins"), reply.alias("answer")))

    no_joins = F.array().cast("array<struct<left:struct<doc:int,sent:int,field:string,quote:string>,right_doc:int,right_field:string,kind:string>>")
    by_nation = answer("copy", point(1, 0, "nation"))
    bridge = refs((0, 0), (1, 0))
    days = {"operands": F.array(point(0, 1, "day"), point(3, 1, "day2")), "labels": F.array(point(0, -1, "title", "title"), point(3, -1, "title2", "title"))}
    nations = {"operands": F.array(point(1, 0, "nation"), point(4, 0, "nation2"))}
    return {
        "copy": program("bridge", bridge, F.array(ask, to_customer), by_nation),
        "composition": program("composition", refs((0, 0), (1, 0), (2, 0)), F.array(ask, to_customer, to_nation), answer("copy", point(2, 0, "region"))),
        "argmin": program("comparison", refs((0, 1), (3, 1)), no_joins, answer("argmin", **days)),
        "argmax": program("comparison", refs((0, 1), (3, 1)), no_joins, answer("argmax", **days)),
        "equal": program("comparison", refs((1, 0), (4, 0)), no_joins, answer("equal", **nations)),
        "common": program("comparison", refs((1, 0), (4, 0)), no_joins, answer("common", **nations)),
        "bool": program("bridge", bridge, F.array(ask, to_customer), answer("bool", value="Yes")),
        "literal": program("bridge", bridge, F.array(ask, to_customer), answer("literal", value="x")),
        "no_anchor": program("bridge", refs((0, 0), (1, 0), (2, 0)), F.array(ask, join(point(0, 0, "customer"), 2)), by_nation),
        "disconnected": program("composition", refs((0, 0), (1, 0), (2, 0)), F.array(ask, to_customer), by_nation),
        "uncited": program("bridge", bridge, F.array(ask, to_customer), answer("copy", point(2, 0, "region"))),
        "unparsed": F.lit("<PROGRAM>{not json}</PROGRAM>"),
        "day": program("bridge", refs((0, 0), (0, 1)), F.array(ask), answer("copy", point(0, 1, "day"))),
    }


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_context(parsed(outputs(pairs(spark, sf_dir))))


def programs_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Every order with a program of one kind."""
    return with_context(parsed(outputs(pairs(spark, sf_dir), F.lit(kind))))


def programs_and(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Every order with the program of its own kind and with one of ``kind``."""
    rows = pairs(spark, sf_dir).withColumn("own", F.explode(F.array("kind", F.lit(kind))))
    return with_context(parsed(outputs(rows, F.col("own"))))


def predictions(rows: DataFrame) -> DataFrame:
    """Stored predictions (id, output, line) of context rows: a tenth is missing, a third has the dataset before its id, and a seventh has
    an older line that can't be read."""
    id = F.when(F.col("k") % 3 == 0, F.concat(F.lit("orders:"), "qid")).otherwise(F.col("qid")).alias("id")
    good = outputs(rows).where("k % 10 != 9").select(id, "output", F.col("k").alias("line"))
    return good.unionByName(rows.where("k % 7 = 0").select(id, F.lit("nonsense").alias("output"), F.lit(-1).cast("long").alias("line")))


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four candidates a question, of the four kinds from its own on, with a made-up likelihood and ranker score."""
    rows = pairs(spark, sf_dir).withColumn("index", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    own = F.get(F.array(*map(F.lit, KINDS)), ((F.col("k") + F.col("index")) % 12).cast("int"))
    rows = rows.withColumns({"own": own, "logprob": -((F.col("k") * 7 + F.col("index") * 13) % 100) / 100, "ranker_score": ((F.col("k") * 11 + F.col("index") * 29) % 17) / 4})
    return with_context(parsed(outputs(rows, F.col("own"))))


#: The same facts for the SQL side.
SQL = """
f AS (SELECT o_orderkey AS k, 'Order#' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS title, c_name AS customer, regexp_replace(n_name, '_(\\d)$', '_0\\1') AS nation, r_name AS region,
             strftime(o_orderdate, '%-d %B %Y') AS day, o_orderdate AS d, o_orderstatus AS status
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT f.*, CAST(f.k AS VARCHAR) AS qid, ['copy','composition','argmin','argmax','equal','common','bool','literal','no_anchor','disconnected','uncited','unparsed'][CAST(f.k % 12 AS INTEGER) + 1] AS kind,
             b.title AS title2, b.customer AS customer2, b.nation AS nation2, b.region AS region2, b.day AS day2, b.d AS d2, b.status AS status2
      FROM f LEFT JOIN f b ON b.k = f.k + 1)
"""


def outcome_sql(kind: str, source: str) -> str:
    """SQL for (valid, certified, answer, sound, errors) of a kind of program over the rows of ``source``; two-order programs of the last
    order have documents out of range (it has no follower)."""
    pair = f"{kind} IN ('argmin','argmax','equal','common')"
    return f"""
SELECT *, sound AND NOT broken AS valid, sound AND NOT broken AND {kind} <> 'bool' AS certified,
       CASE WHEN sound THEN found ELSE '' END AS candidate FROM (
SELECT *, CASE WHEN {kind} IN ('copy','no_anchor','disconnected') THEN nation WHEN {kind} = 'composition' THEN region
     WHEN {kind} = 'argmin' THEN CASE WHEN d2 < d THEN title2 ELSE title END WHEN {kind} = 'argmax' THEN CASE WHEN d2 > d THEN title2 ELSE title END
     WHEN {kind} = 'equal' THEN CASE WHEN nation = nation2 THEN 'yes' ELSE 'no' END WHEN {kind} = 'common' THEN nation WHEN {kind} = 'bool' THEN 'yes' ELSE '' END AS found,
  {kind} NOT IN ('unparsed','missing') AND NOT ({pair} AND title2 IS NULL) AND {kind} NOT IN ('literal','uncited') AND NOT ({kind} = 'common' AND nation <> nation2) AS sound,
  {kind} IN ('no_anchor','disconnected') OR {kind} IN ('unparsed','missing') AS broken FROM {source})"""
