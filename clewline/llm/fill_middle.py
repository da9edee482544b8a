"""Fill-in-the-middle examples: whole lines are cut at two ranks that an indexable skip list finds.

The list of a text holds one node per unit (a line with its break). A link of express lane k spans ``FAN ** k`` units and
carries its width in units and in code points, so a descent that adds up widths reaches the place of any rank, exactly and
in about ``FAN`` steps a lane.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from .registry import query, release, table

FAN = 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Parts of a hundred that are transformed at all, and of these the parts written suffix first.
FIM_RATE, SPM_RATE = 100, 50


class SkipList:
    """Units of a text by rank. ``lanes[k]``: widths of the links of lane k, in units and in code points."""

    def __init__(self, code_points: np.ndarray):
        self.lanes = [(np.ones(len(code_points), dtype=np.int64), code_points)]
        while len(self.lanes[-1][0]) > FAN:
            starts = np.arange(0, len(self.lanes[-1][0]), FAN)
            self.lanes.append(tuple(np.add.reduceat(w, starts) for w in self.lanes[-1]))

    @staticmethod
    def of(text: str) -> SkipList:
        """Units are ``[^\\n]*\\n`` and a last one without a break, if it is not empty."""
        widths = np.fromiter((len(line) + 1 for line in text.split("\n")), np.int64)
        widths[-1] -= 1
        return SkipList(widths if widths[-1] else widths[:-1])

    def __len__(self) -> int:
        return len(self.lanes[0][0])

    def place(self, rank: int) -> int:
        """Code points before the unit of that rank; behind the last unit for ``len(self)``."""
        units = chars = at = 0
        for lane_units, lane_chars in reversed(self.lanes):
            at *= FAN
            while at < len(lane_units) and units + lane_units[at] <= rank:
                units += int(lane_units[at])
                chars += int(lane_chars[at])
                at += 1
        return chars


@arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "low", "high")]))
def _cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    out = np.zeros((len(texts), 3), dtype=np.int64)
    for k, (text, a, b) in enumerate(zip(texts, first.to_pylist(), second.to_pylist())):
        units = SkipList.of(text.as_py() or "")
        low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
        out[k] = len(units), units.place(low), units.place(high)
    release()
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(out[:, k])) for k in range(3)], names=["n", "low", "high"])


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from a hash of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    The cuts depend on the id alone. ``plain`` (output: the text, no cuts) is a null or empty text, one that holds a marker
    itself and one beyond ``fim_rate``. Repeated ids are rows of their own with the same draws; other columns of ``docs``
    are not read; an empty table gives no rows.
    """
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    cut = given.withColumn("cut", _cuts("text", h1, h2)).withColumns({"h3": h3, "h4": h4})
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= fim_rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    low, high = F.col("cut.low"), F.col("cut.high")
    prefix = F.substring("text", F.lit(1), low.cast("int"))
    middle = F.substring("text", (low + 1).cast("int"), (high - low).cast("int"))
    suffix = F.substring("text", (high + 1).cast("int"), F.lit(2**31 - 1))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    cuts = F.col("form") != "plain"
    return cut.withColumn("form", form).select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.when(cuts, low).alias("prefix_chars"), F.when(cuts, high - low).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text of a document from its output and form alone."""
    after = lambda mark: F.substring_index(output, mark, -1)
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(examples: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return examples.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {FIM_RATE} THEN 'plain'
      WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a+1:b], ''), '') AS middle,
    coalesce(array_to_string(u[b+1:n], ''), '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@query("op12_fill_middle_skip_list", ORACLE)
def op12(spark, folder):
    return digest(fill_in_middle(table(spark, folder, "documents")))
