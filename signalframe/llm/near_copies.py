"""N-gram Jaccard join: documents whose sets of word shingles are alike, by adaptive multi-match prefixes.

All tokens (hashed shingles) have one order, rare before common. Two sets x, y with |x & y| >= t |x | y| share at least
l tokens within the first |x| - ceil(t|x|) + l tokens of x and |y| - ceil(t|y|) + l of y; if each set has its own l, at
least the smaller of both. A larger l lengthens a prefix a little and asks for more shared tokens before a pair is
verified, so each document takes the l whose estimated cost is least: long where its prefix tokens are common.

A large group of near copies shares its prefix tokens all round. So candidates aren't paired with each other but with
centres: each class of equal sets belongs to one cluster, and is a guest in the larger clusters that it shares enough
prefix tokens with; so any two that link meet in a cluster. There a set is known by its symmetric difference with the
centre's, and |x ^ y| = |dx ^ dy|: the same prefix rule runs on the differences, in which what the whole group shares
doesn't occur any more. Sets that link to the centre are linked already; only the others look for partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, discarded, mix64, released, text_chunks, word_hashes, word_spans, written
from .graph import components

#: Counters of the token-frequency sketch (a fixed size; it orders tokens, and any order gives right results), and chunks.
SLOTS, CHUNKS = 1 << 20, 64
#: Largest l; cost of verifying a candidate against that of a prefix token; candidates expected of a rare token.
MOST_MATCHES, VERIFY_COST, CHANCE = 12, 100.0, 0.02
#: Bands of the sizes of differences for each centre size; share of a class's prefix that its centre must hold.
BANDS, OWNED = 16, 0.125
#: Rows of ids or pairs of ids that are sent to every task at most; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _sent(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast where its rows are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct k-word shingles, ordered by both; fewer words are one shingle as a whole."""
    released()
    starts, ends, words = word_spans(data, offsets)
    value = word_hashes(LOWER[data], starts, ends)
    doc = np.repeat(np.arange(len(words)), words)
    rank = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    room = np.concatenate([value, np.zeros(k, np.uint64)])
    salt = mix64(np.arange(1, k + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    with np.errstate(over="ignore"):
        total, left = np.zeros(len(value), np.uint64), words[doc] - rank
        size = np.minimum(left, k)
        for j in range(k):
            total += np.where(size > j, room[j : j + len(value)] * salt[j], 0).astype(np.uint64)
        total = mix64(total + size.astype(np.uint64) * salt[k])
    own = (left >= k) | (rank == 0)
    doc, total = doc[own], total[own]
    order = np.lexsort((total, doc))
    doc, total = doc[order], total[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])
    return doc[new], total[new]


def _classes(doc: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document a 64-bit name of its set, which equal sets share, its number of tokens and where they begin."""
    n = np.bincount(doc, minlength=rows)
    begin = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(token ^ np.uint64(0xABCDEF)), dtype=np.uint64)])
        return mix64(sums[begin + n] - sums[begin] + n.astype(np.uint64)).view(np.int64), n, begin


def summaries(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, n, cid) of every document: its set's size and name; and rows (chunk, counts) of the sketch."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                doc, token = shingle_sets(data, offsets, k)
                seen += np.bincount((token >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
                n = j - i
                cid, size, _ = _classes(doc, token, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n).cast(pa.int64()), pa.array(size), pa.array(cid), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["doc_id", "n", "cid", "chunk", "counts"])
        if seen.any():
            squeeze = zstandard.ZstdCompressor(1)
            parts = [squeeze.compress(x.astype("<u4").tobytes()) for x in np.split(seen, CHUNKS)]
            none = pa.nulls(CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(np.arange(CHUNKS)), pa.array(parts, pa.binary())], ["doc_id", "n", "cid", "chunk", "counts"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, n long, cid long, chunk long, counts binary")


def frequency_classes(rows: DataFrame) -> np.ndarray:
    """One byte per slot of the sketch: eight steps for each doubling of the slot's count. A fixed 1 MB."""

    def add(group: pa.Table) -> pa.Table:
        total, open_ = np.zeros(SLOTS // CHUNKS, np.int64), zstandard.ZstdDecompressor()
        for c in group.column("counts"):
            total += np.frombuffer(open_.decompress(c.as_py()), "<u4")
        level = np.minimum(255, np.rint(8 * np.log2(1 + total))).astype(np.uint8)
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "level": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros((CHUNKS, SLOTS // CHUNKS), np.uint8)
    for r in rows.filter("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk long, level binary").collect():
        out[r.chunk] = np.frombuffer(r.level, np.uint8)
    return out.ravel()


def prefixes(docs: DataFrame, level: np.ndarray, k: int, percent: int) -> DataFrame:
    """Rows (token, cid, matches, size): the prefix of each set, once for equal sets of a run of documents.

    ``matches`` is the least number of tokens that a partner must share, ``size`` the length of the prefix.
    """
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        usual = 2.0 ** (np.median(level[level > 0]) / 8) if (level > 0).any() else 1.0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                doc, token = shingle_sets(data, offsets, k)
                rows = len(offsets) - 1
                cid, n, begin = _classes(doc, token, rows)
                own = level[(token >> np.uint64(44)).astype(np.int64)]
                order = np.lexsort((token, own, doc))
                token = token[order]
                # what a token's postings hold beyond chance: the sketch's usual slot stands for a rare token
                cost = np.concatenate([[0.0], np.cumsum(np.maximum(CHANCE, 2.0 ** (own[order] / 8.0) - usual - 4 * np.sqrt(usual)))])
                need = -(-percent * n // 100)
                base = n - need
                best, matches = np.full(rows, np.inf), np.ones(rows, np.int64)
                for m in range(1, MOST_MATCHES + 1):
                    size = np.minimum(base + m, n)
                    total = (cost[begin + size] - cost[begin]) / m * VERIFY_COST + size
                    take = (total < best) & (m <= np.maximum(need, 1))
                    best[take], matches[take] = total[take], m
                size = np.minimum(base + matches, n)
                _, first = np.unique(cid, return_index=True)
                size_ = np.zeros(rows, np.int64)
                size_[first] = size[first]
                inside = np.arange(len(token)) - np.repeat(begin, n) < np.repeat(size_, n)
                of = np.repeat(np.arange(rows), n)[inside]
                if len(of):
                    yield pa.RecordBatch.from_arrays([pa.array(token[inside].view(np.int64)), pa.array(cid[of]), pa.array(matches[of].astype(np.int8)), pa.array(size[of].astype(np.int32))], ["token", "cid", "matches", "size"])

    return docs.filter("doc_id is not null").select("text").mapInArrow(apply, "token long, cid long, matches byte, size int")


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by token and class, each once, those whose token stands in the prefixes of several classes."""
    held: list[np.ndarray] | None = None  # a token's only class so far
    done: tuple[int, int] | None = None  # the last token and class given
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        token, cid = rows[0], rows[1]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])
        if done is not None and len(token):
            new[0] = (int(token[0]), int(cid[0])) != done
        rows = [x[new] for x in rows]
        token = rows[0]
        if not len(token):
            continue
        run = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]]))
        several = np.bincount(run) > 1
        several[0] |= done is not None and done[0] == token[0]
        held, done = (None, (int(token[-1]), int(rows[1][-1]))) if several[-1] else ([x[-1:] for x in rows], None)
        keep = several[run]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows], batch.schema.names)


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Rows (cid, tokens) of the classes (cid, doc_id) wanted: the set of that document, in order, as bytes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(0).to_numpy()
            for i, j, data, offsets in text_chunks(batch.column(1)):
                doc, token = shingle_sets(data, offsets, k)
                cid, n, begin = _classes(doc, token, j - i)
                own = np.flatnonzero(cid == want[i:j])  # a doc_id may have other texts, too
                sets = [token[a:b].tobytes() for a, b in zip(begin[own].tolist(), (begin + n)[own].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cid[own]), pa.array(sets, pa.binary())], ["cid", "tokens"])

    return docs.select("doc_id", "text").join(_sent(wanted), "doc_id").select("cid", "text").mapInArrow(apply, "cid long, tokens binary")


def _differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (c, x, own, n, centre, linked, d) for pairs (x, c, own, most): set sizes, whether both link, and x ^ c.

    Where ``most`` is below what x is away from c, no member of the cluster of c can link with x, and there is no row.
    """
    unit, slack = 100 + percent, 100 - percent

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, linked, parts = [], [], [], []
            most = batch.column(3).fill_null((1 << 62)).to_numpy(zero_copy_only=False)
            for i, (a, b) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                p, q = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                twice = both[1:] == both[:-1]
                alone = np.ones(len(both), bool)
                alone[1:] &= ~twice
                alone[:-1] &= ~twice
                d = both[alone]
                link = unit * len(d) <= slack * (len(p) + len(q))
                if link or unit * len(d) - slack * len(p) <= most[i]:
                    keep.append(i)
                    sizes.append((len(p), len(q)))
                    linked.append(link)
                    parts.append(d.view(np.int64))
            if keep:
                rows = batch.select([0, 1, 2]).take(pa.array(keep))
                ends = np.concatenate([[0], np.cumsum([len(d) for d in parts])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([n for n, _ in sizes], pa.int64()), pa.array([n for _, n in sizes], pa.int64()), pa.array(linked), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))], ["c", "x", "own", "n", "centre", "linked", "d"])

    pairs = written(pairs.select("x", "c", "own", "most"), "near-tried")
    centres = written(pairs.select(F.col("c").alias("cid")).distinct(), "near-centres")
    left = sets.withColumnsRenamed({"cid": "x", "tokens": "p"}).join(_sent(pairs), "x")
    right = sets.join(_sent(centres), "cid").select(F.col("cid").alias("c"), F.col("tokens").alias("q"))
    rows = left.join(right, "c").select("c", "x", "own", "most", "p", "q")
    out = written(rows.mapInArrow(apply, "c long, x long, own boolean, n long, centre long, linked boolean, d array<long>"), "near-differences")
    discarded(pairs, centres)
    return out


def _clusters(posted: DataFrame) -> DataFrame:
    """Rows (cid, c): each class's cluster, named by its centre. Any choice gives right results; a good one few candidates.

    A token speaks for one of its classes: first for that with the largest share of its prefix met elsewhere, which has
    the fewest words of its own; then for the most chosen. A class takes the centre that most of its tokens speak for,
    if that many are enough for a candidate and for a fair share of the class's prefix.
    """

    def choice(rows: DataFrame, rank: list[str], fair: F.Column) -> DataFrame:
        best = Window.partitionBy("token").orderBy(*[F.desc(r) for r in rank], F.desc("cid"))
        votes = rows.select("token", "cid", "matches", "size", F.first("cid").over(best).alias("c"), F.first("matches").over(best).alias("least"), F.first(rank[0]).over(best).alias("top")).filter("top is not null")
        votes = votes.repartition("cid").groupBy("cid", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.least("matches", "least")).alias("need"), F.first("size").alias("size"))
        return votes.filter((F.col("cid") == F.col("c")) | (F.col("n") >= F.greatest("need", fair))).groupBy("cid").agg(F.max(F.struct("n", "c")).alias("s")).select("cid", F.col("s.c").alias("c"))

    first = choice(posted, ["share"], F.lit(0))
    chosen = written(first.groupBy(F.col("c").alias("cid")).agg(F.count(F.lit(1)).alias("chosen")), "near-chosen")
    second = written(choice(posted.join(_sent(chosen), "cid", "left"), ["chosen", "share"], F.col("size") * OWNED).filter("cid <> c"), "near-owners")
    discarded(chosen)
    return second


def _inner_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of cluster members of which one at least isn't linked to the centre and one at least is an owner.

    With s = unit |d| - slack n, two members link where they share (s_x + s_y) / (2 unit) tokens of their differences or
    more. Members are dealt into bands of s; for each pair of bands both have a prefix, rare tokens of the cluster first.
    """
    unit, slack = 100 + percent, 100 - percent
    active = written(members.filter("not linked").select("c").distinct(), "near-active")
    members = members.join(_sent(active), "c")
    members = members.withColumn("s", unit * F.size("d") - slack * F.col("n")).withColumn("width", F.greatest(F.lit(2 * unit), F.floor(unit * F.col("centre") / BANDS))).withColumn("band", F.floor(F.col("s") / F.col("width")))
    bands = written(members.groupBy("c").agg(F.collect_set("band").alias("bands"), F.collect_set(F.when(~F.col("linked"), F.col("band"))).alias("outer_bands")), "near-bands")
    each = members.select("c", "x", F.explode("d").alias("token"))
    often = each.groupBy("c", "token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    met = each.join(often, ["c", "token"]).groupBy("c", "x").agg(F.transform(F.sort_array(F.collect_set(F.struct("f", "token"))), lambda t: t["token"]).alias("met"))
    rows = members.select("c", "x", "own", "linked", "s", "width", "band", F.size("d").alias("size")).join(met, ["c", "x"]).join(_sent(bands), "c")

    def prefix(other: F.Column) -> F.Column:
        share = F.greatest(F.lit(1), F.ceil((F.col("s") + other * F.col("width")) / (2 * unit)))
        length = F.col("size") - share + 1 - (F.col("size") - F.size("met"))  # tokens that no other has come first
        return F.slice("met", F.lit(1), F.greatest(F.lit(0), length).cast("int"))

    def postings(side: DataFrame, others: str, names: tuple[str, str]) -> DataFrame:
        side = side.withColumn("other", F.explode(others))
        return side.select("c", F.col("band").alias(names[0]), F.col("other").alias(names[1]), F.explode(prefix(F.col("other"))).alias("token"), "x", "own", "linked")

    seek = postings(rows.filter("not linked"), "bands", ("i", "j")).drop("linked").withColumnsRenamed({"x": "a", "own": "own_a"})
    found = postings(rows, "outer_bands", ("j", "i")).withColumnsRenamed({"x": "b", "own": "own_b"})
    near = seek.join(found, ["c", "i", "j", "token"]).filter("a <> b and (linked or b < a) and (own_a or own_b)").select("c", "a", "b").distinct()
    own = members.select("c", "x", "n", "d")
    near = near.join(own.withColumnsRenamed({"x": "a", "n": "na", "d": "da"}), ["c", "a"]).join(own.withColumnsRenamed({"x": "b", "n": "nb", "d": "db"}), ["c", "b"])
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    return near.filter(unit * apart <= slack * (F.col("na") + F.col("nb"))).select("a", "b")


def links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): (doc_id, n, cid) of every document, and (cid, component_id) of every class of equal sets.

    1. Documents with equal sets form a class; only classes go on.
    2. A sketch of the frequencies of all tokens orders them; each class has an adaptive prefix.
    3. Prefix tokens of several classes are kept.
    4. Classes are dealt into clusters. A class is also a guest where its prefix shares enough tokens with those of a
       cluster that is larger (or as large, with a larger centre).
    5. Each owner and guest is compared with the centre, and within a cluster by differences (``_inner_links``).
    """
    both = written(summaries(docs, k), "near-summaries")
    level = frequency_classes(both)
    rows = both.filter("chunk is null").select("doc_id", "n", "cid")
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("cid").agg(F.min("doc_id").alias("low"))
    met = prefixes(docs, level, k, percent).repartition("token").sortWithinPartitions("token", "cid").mapInArrow(_shared_tokens, "token long, cid long, matches byte, size int")
    met = written(met, "near-met")
    share = (F.count(F.lit(1)).over(Window.partitionBy("cid")) / F.col("size")).alias("share")
    posted = written(met.select("token", "cid", "matches", "size", share), "near-postings")
    discarded(met)
    owners = _clusters(posted)
    larger = written(owners.groupBy("c").agg(F.count(F.lit(1)).alias("members")), "near-clusters")
    # a cluster has one member more than it has owners beside its centre, whose own cluster may be another
    spread = posted.select("token", "cid", "matches").join(_sent(owners), "cid", "left").withColumn("c", F.coalesce("c", "cid"))
    spread = spread.join(_sent(larger), "c", "left").na.fill(0, ["members"])
    of_token = Window.partitionBy("token")
    spread = spread.withColumn("low", F.min("c").over(of_token)).withColumn("high", F.max("c").over(of_token)).filter("low <> high").drop("low", "high")
    spread = written(spread, "near-spread")
    discarded(posted)
    others = spread.groupBy("token", F.col("c").alias("d")).agg(F.min("matches").alias("least"), F.first("members").alias("size"))
    tried = spread.join(others, "token").filter("struct(size, d) > struct(members, c)").groupBy("cid", "d").agg(F.count(F.lit(1)).alias("n"), F.min(F.least("matches", "least")).alias("need"))
    guests = tried.filter("n >= need").select(F.col("cid").alias("x"), F.col("d").alias("c"))
    pairs = written(owners.select(F.col("cid").alias("x"), "c", F.lit(True).alias("own")).unionByName(guests.withColumn("own", F.lit(False))), "near-pairs")
    wanted = pairs.select(F.explode(F.array("x", "c")).alias("cid")).distinct().join(classes, "cid")
    wanted = written(wanted.select("cid", F.col("low").alias("doc_id")), "near-wanted")
    discarded(spread, owners, larger)
    sets = written(_sets(docs, wanted, k), "near-sets")
    owned = _differences(pairs.filter("own").withColumn("most", F.lit(None).cast("long")), sets, percent)
    # no guest farther than this can link with an owner; in a cluster of the centre alone, with the centre
    reach = owned.groupBy("c").agg(F.max((100 + percent) * F.size("d") + (100 - percent) * F.col("n")).alias("most"))
    guests = _differences(pairs.filter("not own").join(reach, "c", "left").na.fill(-1 << 62, ["most"]), sets, percent)
    members = owned.unionByName(guests)
    inner = written(_inner_links(members, percent), "near-inner")
    edges = members.filter("linked").select(F.col("x").alias("a"), F.col("c").alias("b")).unionByName(inner)
    found = components(edges)
    discarded(wanted, sets, pairs, owned, guests, inner)
    low = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = low.groupBy("component").agg(F.min("low").alias("component_id"))
    return rows, low.join(least, "component").select("cid", "component_id")


def near_copy_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id).

    Words are lower-cased (A to Z); a set is the distinct ``k``-word shingles; fewer words are one shingle; null, empty
    and blank texts have no shingles and link with nothing. Documents link where 100 |x & y| >= percent |x | y|;
    component_id is the smallest doc_id that links reach. A null doc_id is returned with a null component and links with
    nothing; rows that share a doc_id count each with its own text. Long texts count as a whole. No rows give no rows.
    Other columns are not looked at. Words and shingles are told apart by keyed 64-bit hashes.
    """
    rows, classes = links(docs, k, percent)
    named = rows.join(classes, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return named.withColumn("component_id", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id")))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with their columns, that have the smallest doc_id of their group; those that link with none stay.

    Rows that share that doc_id all stay, whatever their texts, and so do rows without a doc_id and those without words.
    """
    groups = near_copy_groups(docs, k, percent).filter("doc_id is not null").groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("component_id").alias("kept"))
    gone = written(groups.filter("kept < gone_id").select("gone_id"), "near-gone")
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
