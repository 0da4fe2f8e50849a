"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandset.llm.common import Scratch, table


def op1_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandset.llm.id_planes import stored_ids

    return stored_ids(table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from strandset.llm.top_k import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandset.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandset.llm.lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandset.llm.decontaminate import contamination, judged

    found = judged(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandset.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandset.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str, whole_lines: bool = False) -> DataFrame:
    from pyspark.sql import functions as F

    from strandset.llm.repeats import without_repeats

    found = without_repeats(table(spark, sf_dir, "documents"), whole_lines=whole_lines)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_units", "n_removed", removed.alias("chars_removed"), spans.alias("spans_removed"), "text")


def op8_repeats_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_repeats(spark, sf_dir, whole_lines=True)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandset.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandset.llm.toxicity import fit, toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from strandset.llm.fill_in_middle import fill_in_middle, restored

    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandset.llm.quality import ledger, passes

    rows = ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes().alias("kept"))


def op12_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandset.llm.quality import POLICIES, ablations, ledger

    rows = Scratch(spark, "quality").keep(ledger(table(spark, sf_dir, "documents")).select("failures"), "ledger")
    out = None
    for policy in POLICIES:
        one = ablations(rows, policy)
        out = one if out is None else out.unionAll(one)
    return out


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandset.llm.resampling import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_id_planes, op2_top_k, op3_main_text, op4_lm_score, op5_decontaminate, op6_near_duplicates, op7_pack, op8_repeats, op8_repeats_lines, op9_token_counts, op10_toxicity, op11_fill_in_middle, op12_quality_rules, op12_rule_ablations,
        op13_resampling,
    )
    return {f.__name__: f for f in found}


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of up to 13 item words, found at every position of every document.
OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""


#: Units, their first occurrences, and runs of later ones with 20 words or more.
OP8 = rf"""
WITH u AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS piece
           FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?\x09-\x0D ]*|[.!?\x09-\x0D ]+') AS p FROM documents)),
w AS (SELECT *, trim(regexp_replace({LOWER.format("piece")}, '[\x09-\x0D ]+', ' ', 'g')) AS norm FROM u),
m AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS stop, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS n,
             norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, pos) > 1 AS later FROM w),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, later ORDER BY pos) AS run FROM m),
x AS (SELECT *, later AND sum(n) OVER (PARTITION BY doc_id, later, run) >= 20 AS gone FROM r),
g AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, coalesce(sum(length(piece)) FILTER (gone), 0) AS chars_removed,
             coalesce(string_agg(piece, '' ORDER BY pos) FILTER (NOT gone), '') AS text FROM x GROUP BY doc_id),
s AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans_removed
      FROM (SELECT doc_id, CAST(min(stop - length(piece)) AS BIGINT) AS a, CAST(max(stop) AS BIGINT) AS b FROM x WHERE gone GROUP BY doc_id, run) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(chars_removed, 0) AS BIGINT) AS chars_removed,
       coalesce(spans_removed, '') AS spans_removed, coalesce(g.text, d.text) AS text FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN s USING (doc_id)
"""


#: Links on full sets; components by repeated minima over the links.
OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT link.a, reach.seen FROM reach JOIN link ON link.b = reach.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, w.doc_id = c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS c FROM reach GROUP BY 1) USING (doc_id)
"""


OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


#: Units by a regular expression, two of them ranked by the digest of the id.
OP11 = """
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
c AS (SELECT *, len(u) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS x FROM u),
k AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a+1:b], '') AS middle, array_to_string(u[b+1:n], '') AS suffix FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def quality_sql() -> str:
    """Measurements of all texts and the bits of the rules that they fail."""
    from strandset.llm.quality import RULES

    count = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    bits = " + ".join(f"CASE WHEN {r.sql()} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x09-\x0D ]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D ]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, {count('[#*$%&|<>]')} AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
             len(l) AS n_lines, {count('[A-Z]')} AS n_upper, {count('[a-z]')} AS n_lower, {count('[!?]')} AS n_marks FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, {bits} AS failures FROM m)"""


def op12_sql() -> str:
    from strandset.llm.quality import CURRENT, mask

    return f"{quality_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & {mask('base')} <> 0 AS base_failed, failures & {mask(CURRENT)} = 0 AS kept FROM b"


def op12_ablation_sql() -> str:
    from strandset.llm.quality import BITS, POLICIES, mask

    each = [
        f"SELECT '{p}' AS policy, '{r}' AS rule, count(*) AS documents, count(*) FILTER (failures & {mask(p)} <> 0) AS rejected, count(*) FILTER (failures & {1 << BITS[r]} <> 0) AS failed, count(*) FILTER (failures & {mask(p)} = {1 << BITS[r]}) AS alone FROM b"
        for p, names in POLICIES.items()
        for r in names
    ]
    return f"{quality_sql()} {' UNION ALL '.join(each)}"


#: Unsigned crc32 of distinct words, byte by byte through a table made by its rule.
OP13 = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
target AS (SELECT unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS w FROM benchmark),
source AS (SELECT doc_id, unnest(w) AS w FROM words),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM source UNION SELECT w FROM target)),
y AS (SELECT w, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM v),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM y, crc),
s AS (SELECT bucket, count(*) AS s FROM source JOIN k USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM target JOIN k USING (w) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM source) AS all_s, (SELECT count(*) FROM target) AS all_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (all_s + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * (all_t + 10000.0::DOUBLE)))) AS gain FROM s FULL JOIN t USING (bucket), n),
d AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM source JOIN k USING (w) JOIN gain USING (bucket) GROUP BY 1),
e AS (SELECT words.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || words.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM words LEFT JOIN d USING (doc_id)),
r AS (SELECT *, n_features >= 20 AS takes_part, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS many FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN takes_part AND place <= 10 * many // 100 THEN place END AS rank FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_top_k": OP2, "op5_decontaminate": OP5, "op6_near_duplicates": OP6, "op8_repeats": OP8, "op11_fill_in_middle": OP11, "op12_quality_rules": op12_sql(), "op12_rule_ablations": op12_ablation_sql(), "op13_resampling": OP13,
    }
