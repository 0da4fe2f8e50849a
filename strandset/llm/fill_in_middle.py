"""Fill-in-middle transformation over units given by the tokenizers library (operator 11).

``Split`` with isolated matches cuts a text into units, a run of letters or one other character each, and tells where each
starts in code points; nothing is trained. The number of offsets is n; digests of the document's id rank two of them, and
those offsets cut the text into prefix, middle and suffix. The worker sends back three numbers a row: texts are sliced and put
together in the JVM.

A text is cut into runs of about RUN code points before it goes to the library, each ending after a character that is no letter
(such a character is a unit by itself, so no unit is cut); offsets of a run that holds no cut are counted and let go. What a
worker holds is one run's offsets, or one word's where a word is longer, beside the text.

A null text counts as empty and an empty text is plain; a null id has the digest of an empty one; repeated rows give repeated
rows; empty tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.llm.common import give_back
from strandset.llm.tokens import forget, text_slices

UNITS = "[A-Za-z]+|[^A-Za-z]"
RUN = 1 << 15  # code points given to the library at once
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, SUFFIX_FIRST = 90, 20  # of a hundred: digests from PLAIN on leave the text plain, those below SUFFIX_FIRST put the suffix first


def runs(text: str, size: int = RUN) -> Iterator[tuple[int, str]]:
    """(first code point, part) of a text in parts of at least ``size`` code points, each ending after a character that is no ASCII letter."""
    import re

    other, at = re.compile("[^A-Za-z]"), 0
    while at < len(text):
        found = other.search(text, at + size - 1) if at + size < len(text) else None
        end = found.end() if found else len(text)
        yield at, text[at:end]
        at = end


class Units:
    """Numbers of units and their offsets by the library's splitter."""

    def __init__(self, pattern: str = UNITS):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(pattern), "isolated").pre_tokenize_str

    def cuts(self, text: str, *digests: int) -> tuple[int, list[int]]:
        """(n, code points before unit digest % (n + 1) for each digest)."""
        parts, last = [], (None, None)
        for at, part in runs(text):
            offsets = self.split(part)
            parts.append((at, part, len(offsets)))
            last = (len(parts) - 1, offsets)
        n, out = sum(p[2] for p in parts), []
        for digest in digests:
            rank, k = digest % (n + 1), 0
            if rank == n:
                out.append(len(text))
                continue
            while rank >= parts[k][2]:
                rank, k = rank - parts[k][2], k + 1
            if last[0] != k:
                last = (k, self.split(parts[k][1]))
            out.append(parts[k][0] + last[1][rank][1][0])
        return n, out


def _cuts():
    import pyarrow as pa

    kind = pa.struct([("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        own = Units()
        forget()
        try:
            for text, h1, h2 in batches:
                one, two, out = h1.to_pylist(), h2.to_pylist(), []
                for first, part in text_slices(text):
                    for i, t in enumerate(part.to_pylist(), first):
                        n, cuts = own.cuts(t or "", one[i], two[i])
                        out.append((n, min(cuts), max(cuts)))
                n, a, b = zip(*out) if out else ((), (), ())
                yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, a, b)], fields=list(kind))
        finally:
            give_back()

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<n:bigint,a:bigint,b:bigint>")


def digest_part(digest: Column, i: int) -> Column:
    """The i-th group of 8 hexadecimal digits of a digest as an unsigned number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: str = "1") -> DataFrame:
    """Rows (id, n, form, prefix_chars, middle_chars, output), one for each row of ``docs``.

    form: ``plain`` (output is the text; both numbers are null) where the text is empty or holds a marker, and for a tenth of the
    digests; else ``spm`` (suffix before prefix) for a fifth, ``psm`` for the others."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(id).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"), digest.alias("__digest"))
    h = [digest_part(F.col("__digest"), i) for i in range(4)]
    t, cut = F.col("__text"), F.col("__cut")
    rows = rows.withColumn("__cut", _cuts()(t, h[0], h[1]))
    plain = (t == "") | (h[2] % 100 >= PLAIN)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(t, F.lit(mark))
    rows = rows.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm"))
    a, b = cut["a"].cast("int"), cut["b"].cast("int")
    prefix, middle, suffix = F.substr(t, F.lit(1), a), F.substr(t, a + 1, b - a), F.substr(t, b + 1)
    mark = [F.lit(m) for m in (PREFIX, SUFFIX, MIDDLE)]
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", F.concat(mark[0], prefix, mark[1], suffix, mark[2], middle)).otherwise(F.concat(mark[1], suffix, mark[0], prefix, mark[2], middle))
    cutting = F.col("form") != "plain"
    return rows.select(
        F.col("__id").alias(id), cut["n"].alias("n"), "form", F.when(cutting, cut["a"]).alias("prefix_chars"), F.when(cutting, cut["b"] - cut["a"]).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made. No marker stands in a text that was cut, and none can begin in a part and end in the
    marker after it, so the first occurrence of each marker is where it was put."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))

    def put(second, psm):
        one = F.split(body, second, 2)
        two = F.split(F.get(one, F.lit(1)), MIDDLE, 2)
        first, last, middle = F.get(one, F.lit(0)), F.get(two, F.lit(0)), F.get(two, F.lit(1))
        return F.concat(first, middle, last) if psm else F.concat(last, middle, first)

    return F.when(form == "plain", output).when(form == "psm", put(SUFFIX, True)).otherwise(put(PREFIX, False))
