"""How far sources of one language differ in their words: a heavy-light split of the terms.

For each language the terms in at least ``least`` of its documents are kept. A group is a
language and a source; its smoothed share of a term in whole billionths is p = 1 + floor(10^9
(n + 1) / (N + V)), and two groups differ in the term by f = floor((p - q)^2 / q). The sum of f
over all kept terms is wanted for every ordered pair of groups of a language.

* Heavy terms, in many of the groups: dense tiles, a matrix of groups by some 2,000 terms,
  summed by numpy for a block of groups against another.
* Light terms, in few: where a term is in neither group, f is the same number f0 for the pair.
  Where it is in one, f depends on its count alone, so a histogram of counts is enough. Where it
  is in both, the term's short posting gives the pair a correction:
  f(p, q) - f(p, q0) - f(p0, q) + f0, for the histograms have counted it twice.

Both sums are whole numbers and are added. Shares are divided out in steps of 1,000, which
stays within 64 bits while N + V is below 9 * 10^15.

A term is light if COST * k^2 < G^2 (k groups of G hold it: pairs of a posting cost about
COST times a cell of a tile) and k is at most LIGHT, the bound of a posting.

In a task terms are told apart by 64-bit hashes of their bytes, between tasks by the bytes.

Cases: null text, lang and source are ''. A group without terms has count 0 for all kept terms;
a language without kept terms gives pairs of value 0. Repeated rows and rows without doc_id
count each for itself; an empty table gives no rows; very long texts are read whole; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.llm import words
from corvida.session import ready, stored

LEAST = 3
TOP = 200
COST = 16
LIGHT = 64
#: Terms of a tile, about, and groups of a block.
TILE = 2048
SIDE = 128
_TILE = "cast(pmod(xxhash64(term), tiles) as int)"
_FLUSH = 500_000
#: Copies of the table of groups that rows of one language are dealt over.
_SALT = 32

#: Bytes that part terms: all of ASCII but letters.
APART = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])


def term_counts(docs: DataFrame) -> DataFrame:
    """Of (lang, source, text): lang, source, term, n (occurrences), df (documents with it)."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        held, fresh = [], 0

        def merged() -> list[tuple]:
            group, key, term, n, df = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((key, group))
            group, key = group[order], key[order]
            at = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]))
            return [(group[at], key[at], term[order][at], np.add.reduceat(n[order], at), np.add.reduceat(df[order], at))]

        def out() -> pa.RecordBatch:
            group, _, term, n, df = held[0]
            known = list(names)
            return pa.RecordBatch.from_arrays([pa.array([known[g][0] for g in group.tolist()]), pa.array([known[g][1] for g in group.tolist()]), pa.array(term.tolist(), pa.binary()), pa.array(n), pa.array(df)], schema=schema)

        for batch in batches:
            for rows, data, offsets in words.pieces(batch):
                start, end, first = words.spans(data, offsets, APART)
                if not len(start):
                    continue
                key = words.hashed(data, start, end, lower=True)
                found = words.distinct(key)
                which = np.searchsorted(found, key)
                seen = np.empty(len(found), np.int64)
                seen[which] = np.arange(len(key))
                low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
                term = np.empty(len(found), object)
                term[:] = [low[a:b].tobytes() for a, b in zip(start[seen].tolist(), end[seen].tolist(), strict=True)]
                group = np.array([names.setdefault(x, len(names)) for x in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)], np.int64)
                # occurrences of each term in each document, then in each group
                each, n = np.unique(np.repeat(np.arange(rows.num_rows), np.diff(first)) * len(found) + which, return_counts=True)
                cell = group[each // len(found)] * len(found) + each % len(found)
                order = np.argsort(cell, kind="stable")
                cell = cell[order]
                at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                kind = cell[at] % len(found)
                held.append((cell[at] // len(found), found[kind], term[kind], np.add.reduceat(n[order], at), np.diff(np.append(at, len(cell)))))
                fresh += len(at)
                if fresh >= _FLUSH:
                    held = merged()
                    fresh = 0
                    if len(held[0][0]) >= _FLUSH:
                        yield out()
                        held = []
        if held:
            held = merged()
            yield out()

    made = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term binary, n long, df long")
    return made.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: str, total: str) -> str:
    """SQL for 1 + floor(10^9 * (n + 1) / total), in steps that stay within 64 bits."""
    rest, out = f"(({n}) + 1) % ({total})", f"(({n}) + 1) div ({total})"
    for _ in range(3):
        out = f"({out}) * 1000 + ((({rest}) * 1000) div ({total}))"
        rest = f"(({rest}) * 1000) % ({total})"
    return f"(1 + {out})"


def _share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same of arrays."""
    out, rest = np.divmod(n + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _f(p: str, q: str) -> Column:
    """floor((p - q)^2 / q)."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def vocabulary(counts: DataFrame, groups: DataFrame, least: int = LEAST, cost: int = COST, light: int = LIGHT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept counts, groups and tiles.

    Counts: lang, source, term, n, total (in the language), heavy, and of the group: size (N), lang_size, v, tiles.
    Groups: lang, source, size, lang_size, v, n_heavy, tiles, number (of the source in its language).
    Tiles: lang, tile, n_terms."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df"), F.count(F.lit(1)).alias("k")).where(F.col("df") >= least).drop("df")
    of_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("g"))
    heavy = (F.col("k") > light) | (cost * F.col("k") * F.col("k") >= F.col("g") * F.col("g"))
    kept = stored(kept.join(of_lang, "lang").withColumn("heavy", heavy).drop("k", "g"), "kept-terms")
    rows = stored(counts.drop("df").join(kept, ["lang", "term"]), "kept-counts")
    sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.when(~F.col("heavy"), 1)).alias("n_light"))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_size"), F.count(F.lit(1)).alias("v"), F.count(F.when(F.col("heavy"), 1)).alias("n_heavy"))
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "n_light", "lang_size", "v", "n_heavy"])
    groups = groups.withColumn("tiles", F.ceil(F.col("n_heavy") / F.lit(TILE)).cast("int"))
    groups = stored(groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")
    rows = rows.join(groups.select("lang", "source", "size", "lang_size", "v", "tiles", "number"), ["lang", "source"])
    tiles = kept.where("heavy").join(groups.select("lang", "tiles").distinct(), "lang").groupBy("lang", F.expr(_TILE).alias("tile")).agg(F.count(F.lit(1)).alias("n_terms"))
    return rows, groups, tiles


def dense_sums(rows: DataFrame, groups: DataFrame, tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """The heavy terms' sums: lang, source, item, value. A tile has every group of two blocks, and its share of the terms."""
    cells = rows.where("heavy").select("lang", "source", "number", "size", "v", F.expr(_TILE).alias("tile"), "term", "n")
    # a row without term for each group of a tile, with the tile's number of terms
    heads = groups.select("lang", "source", "number", "size", "v").join(tiles, "lang").select("lang", "source", "number", "size", "v", "tile", F.lit(None).cast("string").alias("term"), F.col("n_terms").alias("n"))
    blocks = groups.groupBy("lang").agg(F.expr(f"cast(max(number) div {side} as int)").alias("last"))
    both = cells.unionByName(heads).join(blocks, "lang").withColumn("own", F.expr(f"cast(number div {side} as int)"))
    pairs = F.expr("concat(transform(sequence(0, last), x -> struct(own as p, x as q)), transform(filter(sequence(0, last), x -> x <> own), x -> struct(x as p, own as q)))")
    dealt = both.withColumn("pair", F.explode(pairs)).select("lang", "tile", "pair.p", "pair.q", "own", "source", "size", "v", "term", "n")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, p, q = pdf["lang"].iloc[0], pdf["p"].iloc[0], pdf["q"].iloc[0]
        head = pdf[pdf["term"].isna()].sort_values("source").reset_index(drop=True)
        cell = pdf[pdf["term"].notna()]
        at = {s: i for i, s in enumerate(head["source"])}
        kind, terms = pd.factorize(cell["term"])
        n = np.zeros((len(head), len(terms)), np.int64)
        n[cell["source"].map(at).to_numpy(np.int64), kind] = cell["n"]
        value = _share(n, (head["size"] + head["v"]).to_numpy()[:, None])
        # terms that no group of the two blocks has
        none, missing = _share(np.zeros(len(head), np.int64), (head["size"] + head["v"]).to_numpy()), int(head["n"].iloc[0]) - len(terms)
        own = head["own"].to_numpy()
        mine, other = np.flatnonzero(own == p), np.flatnonzero(own == q)
        right, out = value[other], []
        for i in mine.tolist():
            apart = value[i] - right
            out.append((apart * apart // right).sum(axis=1) + missing * ((none[i] - none[other]) ** 2 // none[other]))
        names = head["source"].to_numpy()
        made = pd.DataFrame({"lang": lang, "source": np.repeat(names[mine], len(other)), "item": np.tile(names[other], len(mine)), "value": np.concatenate(out) if out else np.empty(0, np.int64)})
        return made[made["source"] != made["item"]]

    return dealt.groupBy("lang", "tile", "p", "q").applyInPandas(tile, "lang string, source string, item string, value long")


def sparse_sums(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The light terms' sums, in parts: lang, source, item, value."""
    light = rows.where("not heavy")
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1)))

    def others(left: DataFrame, *salted: str) -> DataFrame:
        """Rows with every other group of their language (its columns begin with o_)."""
        right = groups.select("lang", *(F.col(c).alias(f"o_{c}") for c in ("source", "size", "n_light"))).withColumn("salt", salts)
        return left.withColumn("salt", F.pmod(F.xxhash64(*salted), F.lit(_SALT)).cast("int")).join(right, ["lang", "salt"]).where("source <> o_source")

    size, other = "size + v", "o_size + v"
    zero = f"if(v = 0, 1, {share('0', size)})", f"if(v = 0, 1, {share('0', other)})"
    none = others(groups, "source").select("lang", "source", F.col("o_source").alias("item"), ((F.col("v") - F.col("n_heavy") - F.col("n_light") - F.col("o_n_light")) * _f(*zero)).alias("value"))
    counts = light.groupBy("lang", "source", "size", "v", "n").agg(F.count(F.lit(1)).alias("times"))
    one = others(counts, "source", "n").withColumn("p", F.expr(share("n", size))).withColumn("q0", F.expr(zero[1]))
    as_p = one.select("lang", "source", F.col("o_source").alias("item"), (F.col("times") * _f("p", "q0")).alias("value"))
    as_q = one.select("lang", F.col("o_source").alias("source"), F.col("source").alias("item"), (F.col("times") * _f("q0", "p")).alias("value"))
    # a posting has LIGHT groups at most
    postings = light.select("lang", "term", F.struct("source", F.expr(share("n", size)).alias("p"), F.expr(share("0", size)).alias("p0")).alias("x"))
    postings = postings.groupBy("lang", "term").agg(F.collect_list("x").alias("x")).where(F.size("x") > 1)
    met = postings.select("lang", F.explode("x").alias("i"), "x").select("lang", "i", F.explode("x").alias("j")).where("i.source <> j.source")
    gain = _f("i.p", "j.p") - _f("i.p", "j.p0") - _f("i.p0", "j.p") + _f("i.p0", "j.p0")
    both = met.select("lang", F.col("i.source").alias("source"), F.col("j.source").alias("item"), gain.alias("value"))
    return none.unionByName(as_p).unionByName(as_q).unionByName(both)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP, cost: int = COST, light: int = LIGHT, side: int = SIDE) -> DataFrame:
    """lang, source, part, item, value, rank: for each group every other source of its language
    (part ``pair``), and the ``top`` terms it has more often than its language (part ``term``)."""
    ready(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    groups = stored(docs.select("lang", "source").distinct(), "groups-found")
    rows, groups, tiles = vocabulary(stored(term_counts(docs), "term-counts"), groups, least, cost, light)
    pairs = dense_sums(rows, groups, tiles, side).unionByName(sparse_sums(rows, groups)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = rows.withColumn("p", F.expr(share("n", "size + v"))).withColumn("q", F.expr(share("total", "lang_size + v"))).where("p > q").select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("rank", order).withColumn("part", F.lit("pair")).select(columns)
    # Spark keeps the first of each group before the shuffle, so no task gets all terms of a hot group
    terms = terms.withColumn("rank", order).where(F.col("rank") <= top).withColumn("part", F.lit("term")).select(columns)
    return pairs.unionByName(terms)
