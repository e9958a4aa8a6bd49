"""How far the sources of each language differ in the words they use.

Equal texts of a language are one text with a count for each source; each is cut into
terms once, and its terms count as often as the text stands in a source. A term is a
run of ASCII letters and signs beyond ASCII, only A-Z in lower case. A language keeps
the terms of ``least_docs`` of its documents or more. With N the occurrences of kept
terms in a group and V the kept terms, a term has the share

    p = 1 + floor(scale * (count + add) / (N + add * V))

in every group (lang, source), and likewise in the language. Two sources are as far
apart as their shares differ, summed over all kept terms. Only terms that occur in one of
the two are looked at; each of the others adds the same difference.

Nulls in lang, source and text are ''. Rows are documents, repeated ones too. A
group without terms has the shares of terms that do not occur; a language without
kept terms has pairs of value 0 and no terms. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritpool.llm.frames import blocks, landed
from meritpool.llm.words import LOWER

#: Fixed values of the contract.
LEAST_DOCS = 30
ADD = 5
SCALE = 1_000_000_000
TOP = 50

#: Bytes of text cut into terms together; a longer text goes alone.
TERM_BLOCK = 16 << 20
#: Sources that are compared with each other in one group of rows, and kept terms of such a group, about.
TILE = 256
TERMS_EACH = 1024

#: Bytes of terms: letters, and every byte of a sign beyond ASCII.
TERM_BYTES = np.array([i >= 128 or chr(i).isalpha() for i in range(256)])

_POSTINGS = "lang string, term string, df long, sources array<struct<source:string,n:long>>"


def collapsed(docs: DataFrame) -> DataFrame:
    """lang, text and copies (source and count) of each different text of a language.

    Counts are added up by digest before any text moves, and copies of a text within
    a map task send it once, so many copies of one text are no hot group.
    """
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    named = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = (
        named.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
        .groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    )
    texts = named.select("lang", "digest", "text").dropDuplicates(["lang", "digest"])
    return texts.join(copies, ["lang", "digest"]).select("lang", "text", "copies")


def term_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The terms of some texts: text and code of each term, and the different terms by code."""
    inside = TERM_BYTES[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    opens[heads] = inside[heads]
    starts = np.flatnonzero(opens)
    solid = np.cumsum(inside)
    at = np.empty(len(starts) + 1, np.int64)
    at[:-1], at[-1] = solid[starts] - 1, solid[-1] if len(solid) else 0
    text = np.searchsorted(offsets, starts, "right") - 1
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(LOWER[data[inside]]))
    coded = terms.dictionary_encode()
    return text, coded.indices.to_numpy(), coded.dictionary


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys in order, and the exact sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted counts of the terms of collapsed texts, by block of texts."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        lang_of, langs = langs.indices.to_numpy(), langs.dictionary
        copies = batch.column("copies")
        bounds = copies.offsets.to_numpy().astype(np.int64)
        bounds, items = bounds - bounds[0], copies.flatten()
        named = items.field("source").dictionary_encode()
        source_of, sources, times = named.indices.to_numpy(), named.dictionary, items.field("n").to_numpy()
        for row, end, data, offsets in blocks(batch.column("text"), TERM_BLOCK):
            text, code, terms = term_codes(data, offsets)
            if not len(code):
                continue
            many = len(terms)
            pair, n = _sums(text.astype(np.int64) * many + code, np.ones(len(code), np.int64))
            text, code = pair // many + row, pair % many
            # one row for each source that has the text
            each = bounds[text + 1] - bounds[text]
            rows = np.repeat(np.arange(len(text)), each)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each) + bounds[text][rows]
            key = (lang_of[text[rows]].astype(np.int64) * many + code[rows]) * len(sources) + source_of[place]
            key, n, df = _sums(key, n[rows] * times[place], times[place])
            owner, source = key // len(sources), key % len(sources)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            owner = owner[first]
            listed = pa.ListArray.from_arrays(
                pa.array(np.append(first, len(key)).astype(np.int32)),
                pa.StructArray.from_arrays([sources.take(pa.array(source)), pa.array(n)], ["source", "n"]),
            )
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(owner // many)), terms.take(pa.array(owner % many)).cast(pa.string()),
                 pa.array(np.add.reduceat(df, first)), listed],
                ["lang", "term", "df", "sources"],
            )


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of the module's formula, in whole numbers."""
    top = (count + ADD).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + ADD * kept).cast("decimal(19,0)")) + 1


def _apart(postings: pa.Table) -> pa.Table:
    """Sums of differences over the terms of one shard, for the pairs of one or two tiles.

    Rows without a term name the sources of the tiles and their share of an absent term.
    """
    base = postings.filter(postings["term"].is_null()).sort_by([("tile", "ascending"), ("source", "ascending")])
    given = postings.filter(postings["term"].is_valid())
    terms = given["term"].combine_chunks().dictionary_encode() if len(given) else None
    names = base["source"].combine_chunks()
    least = base["p"].to_numpy()
    tile = base["tile"].to_numpy()
    n_terms = len(terms.dictionary) if terms is not None else 0
    shares = np.repeat(least[:, None], max(n_terms, 1), axis=1)[:, :n_terms]
    if n_terms:
        column = pa.compute.index_in(given["source"].combine_chunks(), names).to_numpy()
        shares[column, terms.indices.to_numpy()] = given["p"].to_numpy()
    left, right, part, gap = [], [], [], []
    for i in range(len(base)):
        others = np.arange(i + 1, len(base))
        if tile[0] != tile[-1]:  # pairs of two tiles; those within one have a group of their own
            others = others[tile[others] != tile[i]]
        left.append(np.full(len(others), i))
        right.append(others)
        part.append(np.abs(shares[others] - shares[i]).sum(axis=1) if n_terms else np.zeros(len(others), np.int64))
        gap.append(np.abs(least[others] - least[i]))
    left, right = np.concatenate(left), np.concatenate(right)
    n = len(left)
    return pa.table({
        "lang": pa.array([base["lang"][0].as_py()] * n, pa.string()),
        "a": names.take(pa.array(left)), "b": names.take(pa.array(right)),
        "part": pa.array(np.concatenate(part).astype(np.int64)), "gap": pa.array(np.concatenate(gap).astype(np.int64)),
        "seen": pa.array(np.full(n, n_terms, np.int64)),
    })


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item, value for each two sources of a language, both ways.

    Postings are dealt out by shard of terms and by pair of tiles of sources, so that a
    group holds some thousand terms of at most two tiles however many there are.
    """
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    tiled = groups.withColumn("tile", F.floor(place / TILE).cast("int"))
    tiles = F.max("tile").over(Window.partitionBy("lang")) + 1
    shards = F.ceil((F.col("kept") + 1) / TERMS_EACH).cast("int")
    tiled = landed(tiled.select("lang", "source", "tile", tiles.alias("tiles"), shards.alias("shards"), "kept", F.col("absent").alias("p")))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    rows = (
        shares.select("lang", "source", "term", "p").join(tiled.drop("p"), ["lang", "source"])
        .withColumn("shard", F.pmod(F.xxhash64("term"), "shards").cast("int"))
        .unionByName(
            tiled.withColumns({"term": F.lit(None).cast("string"), "shard": F.explode(F.sequence(F.lit(0), F.col("shards") - 1))})
        )
        .select("lang", "source", "term", "p", "tile", "shard", other)
    )
    dealt = rows.withColumns({"one": F.least("tile", "other"), "two": F.greatest("tile", "other")})
    sums = (
        dealt.groupBy("lang", "one", "two", "shard")
        .applyInArrow(_apart, "lang string, a string, b string, part long, gap long, seen long")
        .groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.max("gap").alias("gap"), F.sum("seen").alias("seen"))
    )
    kept = tiled.groupBy("lang").agg(F.max("kept").alias("kept"))
    valued = sums.join(kept, "lang").withColumn("value", F.col("part") + (F.col("kept") - F.col("seen")) * F.col("gap"))
    both = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return valued.select("lang", both, "value")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part ``pair``: the other sources of the language by their distance. Part ``term``: the
    ``top`` terms of the source whose share is over the language's, by the difference. Equal
    values are ranked by the bytes of the item. Other columns of ``docs`` are not looked at.
    """
    postings = landed(collapsed(docs).mapInArrow(_cut, _POSTINGS))
    kept = postings.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least_docs).select("lang", "term")
    counts = landed(
        postings.join(kept, ["lang", "term"], "left_semi").select("lang", "term", F.inline("sources"))
        .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    )
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
        .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .fillna(0, ["total", "kept", "lang_total"])
    )
    groups = landed(
        groups.withColumn("absent", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(0))
    )
    shares = (
        counts.join(groups, ["lang", "source"])
        .withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
        .select("lang", "source", "term", "p", "kept", "lang_total")
    )
    pairs = _pairs(groups, shares).withColumn("part", F.lit("pair"))
    over = (
        shares.join(terms, ["lang", "term"])
        .withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
        .where("value > 0").select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    )
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = over.withColumn("rank", place).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", place).unionByName(best)
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
