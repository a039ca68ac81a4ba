"""How far each source of a language departs from the other sources and from the language as a whole.

Every group, a (language, source), is a vector of term shares over the V kept terms of its language.
The divergence of a group from a peer is a sum over all V terms, most of which occur in neither. By
Gustavson's row-wise product a group only follows the terms it has: each leads through the
term-major index to the peers that have it too, and what they share is added into one dense
accumulator with a place for every peer. No pair of postings leaves a task, only filled accumulators.

What the sparse product leaves out is exact as well. With ``f(p, q)`` the summand, ``p0`` and ``q0``
the shares of a term that does not occur, and sums over the terms of the group, of the peer, of both::

    V f(p0,q0) + sum_group [f(p,q0) - f(p0,q0)] + sum_peer [f(p0,q) - f(p0,q0)]
               + sum_both [f(p,q) - f(p,q0) - f(p0,q) + f(p0,q0)]

The two middle sums depend on a group only through how many of its terms have which share, so they
are taken over that histogram. All numbers are integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.llm.batches import byte_map, slices, utf8
from tagweave.session import stage

#: Shares are parts of this; terms of fewer documents are not kept; terms listed for a group.
UNIT, LEAST_DOCS, TERMS_LISTED = 1_000_000_000, 3, 200
#: Distinct (group, term) counts a task holds before it hands them on, postings of a block of the
#: index, peers of a block of accumulators, and parts a group's terms are ranked in first.
HELD, BLOCK_POSTINGS, BLOCK_PEERS, RANK_PARTS = 400_000, 65_536, 256, 32

#: ASCII that is no letter.
_BLANK = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_COUNTS = "lang string, source string, term string, n long, docs long"
_PAIRS = "lang string, source string, item string, value long"


def _task_counts(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Occurrences of a term in a group and documents that have it, as far as this task has seen."""
    table = byte_map(lower=True, blank=_BLANK)
    tallies: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in tallies.items():
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string(), safe=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(n), pa.string()),
                    pa.array([source] * len(n), pa.string()),
                    terms,
                    pa.array(n.values(), pa.int64()),
                    pa.array(map(docs.__getitem__, n), pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        tallies.clear()

    for batch in slices(batches):
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)))
        for lang, source, text in rows:
            words = text.translate(table).split()
            if not words:
                continue
            n, docs = tallies.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n) - before
            if size > held:
                yield from handed_on()
                size = 0
    yield from handed_on()


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """``lang, source, term, n, docs`` of every term in every group."""
    found = docs.mapInArrow(lambda batches: _task_counts(batches, held), _COUNTS)
    sums = {name: F.sum(name).alias(name) for name in ("n", "docs")}
    return found.groupBy("lang", "source", "term").agg(*sums.values())


def _share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """The share of a term with ``n`` occurrences, exact for any sizes."""
    made = f"1 + (CAST({n} + 1 AS DECIMAL(19,0)) * {UNIT}) div CAST({total} + {terms} AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {terms} = 0 THEN 1 ELSE {made} END").cast("long")


def summand(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)^2 / q)`` of positive integers up to 3 x 10^9."""
    gap = p - q
    return gap * gap // q


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; a run may be empty."""
    edges = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return edges[ends] - edges[ends - sizes]


def shared_terms(block: pa.Table) -> pa.Table:
    """What terms in common add, for every group and peer of one block of the term-major index.

    Each group's row scatters its terms through the index into an accumulator over the peers.
    """
    source = block.column("source").combine_chunks().dictionary_encode()
    names, row = source.dictionary, source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    term = block.column("term").combine_chunks().dictionary_encode().indices
    term = term.to_numpy(zero_copy_only=False).astype(np.int64)
    p, p0 = (block.column(c).to_numpy() for c in ("p", "p0"))
    lang = block.column("lang")[0].as_py()

    by_term = np.argsort(term, kind="stable")
    peers, shares = row[by_term], p[by_term]
    sizes = np.bincount(term)
    firsts = np.cumsum(sizes) - sizes
    unseen = np.empty(len(names), dtype=np.int64)
    unseen[row] = p0

    by_row = np.argsort(row, kind="stable")
    places = np.split(by_row, np.cumsum(np.bincount(row))[:-1])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for group, own in enumerate(places):
        length = sizes[term[own]]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(firsts[term[own]] - (ends - length), length)
        peer, q, own_p = peers[at], shares[at], np.repeat(p[own], length)
        q0, own_p0 = unseen[peer], unseen[group]
        more = summand(own_p, q) - summand(own_p, q0) - summand(own_p0, q) + summand(own_p0, q0)
        accumulator = np.zeros(len(names), dtype=np.int64)
        np.add.at(accumulator, peer, more)
        accumulator[group] = 0
        filled = np.flatnonzero(accumulator)
        out.append((np.full(len(filled), group), filled, accumulator[filled]))
    group, peer, value = (np.concatenate(part) for part in zip(*out))
    columns = [pa.array([lang] * len(group), pa.string()), names.take(group), names.take(peer), pa.array(value)]
    return pa.table(columns, names=["lang", "source", "item", "value"])


def _unshared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rest of the sum for a group and a block of peers, as if they had no term in common."""
    for batch in batches:
        for row in batch.to_pylist():
            peers = row["peers"]
            q0 = np.array([peer["p0"] for peer in peers], dtype=np.int64)
            p0 = np.int64(row["p0"])
            neither = summand(p0, q0)
            p, n = (np.array(row[c], dtype=np.int64) for c in ("shares", "share_terms"))
            value = row["kept_terms"] * neither
            for at in range(0, len(p), 1024):
                some = p[at : at + 1024, None], n[at : at + 1024, None]
                value = value + ((summand(some[0], q0[None, :]) - neither) * some[1]).sum(axis=0)
            sizes = np.array([len(peer["shares"]) for peer in peers], dtype=np.int64)
            q = np.array([x for peer in peers for x in peer["shares"]], dtype=np.int64)
            m = np.array([x for peer in peers for x in peer["share_terms"]], dtype=np.int64)
            value = value + _sums((summand(p0, q) - np.repeat(neither, sizes)) * m, sizes)
            kept = [i for i, peer in enumerate(peers) if peer["source"] != row["source"]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["lang"]] * len(kept), pa.string()),
                    pa.array([row["source"]] * len(kept), pa.string()),
                    pa.array([peers[i]["source"] for i in kept], pa.string()),
                    pa.array(value[kept]),
                ],
                names=["lang", "source", "item", "value"],
            )


def _ranked(rows: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(order))


def divergence(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    listed: int = TERMS_LISTED,
    block_postings: int = BLOCK_POSTINGS,
    block_peers: int = BLOCK_PEERS,
    held: int = HELD,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of ``docs(text, lang, source)``.

    Part ``pair`` ranks the other sources of the language by their divergence, all of them; part
    ``term`` the ``listed`` terms that a group has more of than its language and that add most. A
    term is a run of letters of any script, A-Z in lower case; null text, language and source are
    empty strings; every row is a document, also if it repeats another. A group whose texts are
    empty has no terms, but is a group. A language without kept terms has divergences of zero. No
    documents give no rows; other columns are not read.

    A task keeps the counts of ``held`` (group, term) pairs, a block of the index, or a group with
    ``block_peers`` peers; none of these numbers changes a result. Writes the groups and the kept
    postings. The answer has a row for any two sources of a language, as asked for.
    """
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    docs = docs.select(*read)
    whole = Window.partitionBy("lang", "term")
    counted = term_counts(docs, held)
    # A term has one row for each source here, which any number of documents cannot exceed.
    postings = (
        counted.withColumns(
            {
                "lang_docs": F.sum("docs").over(whole),
                "lang_n": F.sum("n").over(whole),
                "first": (F.min("source").over(whole) == F.col("source")).cast("long"),
            }
        )
        .where(F.col("lang_docs") >= least_docs)
        .drop("docs", "lang_docs")
    )
    postings = stage(postings, "postings")

    sums = postings.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.sum("first").alias("firsts"), F.count("*").alias("postings")
    )
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    groups = stage(groups.na.fill(0), "groups")
    langs = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"),
        F.sum("firsts").alias("kept_terms"),
        F.ceil(F.count("*") / block_peers).cast("int").alias("peer_blocks"),
        F.ceil(F.sum("postings") / block_postings).cast("int").alias("blocks"),
    )
    groups = groups.join(langs, "lang").select(
        "lang", "source", "total", "lang_total", "kept_terms", "blocks", "peer_blocks",
        _share("0", "total", "kept_terms").alias("p0"),
    )
    groups = stage(groups, "groups")
    shares = postings.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        _share("n", "total", "kept_terms").alias("p"),
        _share("lang_n", "lang_total", "kept_terms").alias("q"),
        "p0",
        F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"),
    )
    shares = stage(shares, "shares")

    terms = shares.where("p > q").select(
        "lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value")
    )
    part = F.pmod(F.xxhash64("item", F.lit(1)), F.lit(RANK_PARTS))
    best = _ranked(terms.withColumn("part", part), "lang", "source", "part").where(F.col("rank") <= listed)
    best = _ranked(best.drop("part", "rank"), "lang", "source").where(F.col("rank") <= listed)

    kinds = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("kinds"))
    rows = groups.join(kinds, ["lang", "source"], "left").select(
        "lang",
        "source",
        "kept_terms",
        "p0",
        F.pmod(F.xxhash64("source"), F.col("peer_blocks")).alias("peer_block"),
        F.coalesce(F.col("kinds.p"), F.array().cast("array<long>")).alias("shares"),
        F.coalesce(F.col("kinds.n"), F.array().cast("array<long>")).alias("share_terms"),
    )
    rows = stage(rows, "kinds")
    peers = rows.groupBy("lang", "peer_block").agg(
        F.collect_list(F.struct("source", "p0", "shares", "share_terms")).alias("peers")
    )
    rest = rows.drop("peer_block").join(peers, "lang").mapInArrow(_unshared, _PAIRS)
    common = shares.groupBy("lang", "block").applyInArrow(shared_terms, _PAIRS)
    pairs = common.unionByName(rest).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = _ranked(pairs, "lang", "source").withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(best.withColumn("part", F.lit("term")).select(*columns))
