"""Line dedup: lines found in several documents stay only in the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import LOWER, UPPER, WHITE, fresh, hash_pair
from postmill.session import cut

MIN_CHARS = 10
MIN_DOCS = 2


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """`docs` with `text_col` rebuilt, plus n_lines (before) and n_dropped.

    Lines are split at \\n. A key of at least `min_chars` code points that at least `min_docs` (2 or more)
    distinct ids hold loses all its lines except those in the smallest id. Rows with one id are one
    document; a null id counts as one document after all others. Null or empty text is one empty line.
    Other columns are kept; the names n_lines and n_dropped, if present, are replaced.

    Only 128-bit line hashes travel. Holders are counted per hash with map-side aggregation, so a line in
    a third of all documents is a few rows per task; the lines then meet their hash in a join that Spark
    can split, and go back to their rows as lists of positions.
    """
    if min_docs < 2:
        raise ValueError("min_docs is 2 or more")
    col = fresh("lines")
    doc, body, drop, pos, h1, h2, first, last, t1, t2 = map(col, "doc body drop pos h1 h2 first last t1 t2".split())
    a, b = hash_pair(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.withColumns({
        doc: F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), t1: a, t2: b,
        body: F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"),
    })
    exploded = keyed.select(doc, t1, t2, F.posexplode(F.transform(body, line_key)).alias(pos, "key")).filter(
        F.char_length("key") >= min_chars
    )
    a, b = hash_pair(F.col("key"))
    lines = exploded.select(doc, t1, t2, pos, a.alias(h1), b.alias(h2))
    holders = lines.groupBy(h1, h2).agg(F.min(doc).alias(first), F.max(doc).alias(last)).filter(F.col(first) < F.col(last))
    if min_docs > 2:
        wide = lines.join(holders, [h1, h2], "left_semi").select(h1, h2, doc).distinct().groupBy(h1, h2).count()
        holders = holders.join(wide.filter(F.col("count") >= min_docs).select(h1, h2), [h1, h2])
    # cut, so that the join deals both sides out itself and Spark can split a line that very many rows hold
    dropped = (
        lines.join(cut(holders.select(h1, h2, first)), [h1, h2])
        .filter(F.col(doc) > F.col(first))
        .groupBy(doc, t1, t2)
        .agg(F.collect_set(pos).alias(drop))
    )
    joined = keyed.join(dropped, [doc, t1, t2], "left")
    rest = F.array_except(F.sequence(F.lit(0), F.size(body) - 1), F.col(drop))
    kept = F.when(F.col(drop).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.transform(rest, lambda i: F.get(F.col(body), i)), "\n")
    )
    keep = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    return joined.select(
        *keep, kept.alias(text_col), F.size(body).cast("long").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
    )
