"""Near-duplicate documents by a chosen-path set similarity join on MinHash tokens.

1. Each document becomes its set of word shingles. Equal sets are one class; from here on only class representatives count.
2. A tree starts at one of the representative's minwise tokens: all that share the token's value form a node. `trees`
   independent trees are grown. Two sets of similarity s share a root with probability s in each tree, so that
   1 - (1 - s)**trees is the recall at the root (0.999997 for 0.8 and 8 trees), and each branching keeps over 0.99 of it.
3. The first tree gives most links: its nodes of up to `small` members are compared exhaustively, the members of larger ones with
   the most central one. What is linked so far makes components (alternating large and small stars).
4. In all trees only pairs of different components are left. A node of up to `small` members is compared exhaustively; in a larger
   one the members outside its main component are compared with all, if these pairs are few. Else the node branches: each
   member goes to one child for each of `branches` further tokens chosen by the node's key.

Comparing means: on minwise tokens first, then on the full sets of those that agree in enough tokens. A node's members may be any
share of all rows: they are dealt to blocks of bounded size, and a group that meets in one task holds `small` sets or about two
blocks. Pairs are formed inside such a group only; what leaves it is a spanning forest of the confirmed links, which has the
same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import Scratch, joined, partitions
from ._text import SPACE, U, chunks, mix, shingles, words

COORDINATES = 64
_A = mix(np.arange(1, COORDINATES + 1, dtype=U)) | U(1)
_B = mix(np.arange(1001, COORDINATES + 1001, dtype=U))


def shingle_sets(texts: pa.Array, k: int, separator: np.ndarray = SPACE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of the whole sequence if it has fewer words."""
    w = words(texts, separator)
    all_k = shingles(w.hash, k)
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= k:
            yield np.unique(all_k[a : b - k + 1])
        elif b > a:
            yield shingles(w.hash[a:b], int(b - a))
        else:
            yield np.empty(0, U)


def min_tokens(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of COORDINATES hash functions."""
    out = np.full(COORDINATES, 0xFFFFFFFF, U)
    for at in range(0, len(hashes), 4096):
        part = ((hashes[at : at + 4096, None] * _A + _B) >> U(32)).min(0)
        out = np.minimum(out, part)
    return out.astype(np.uint32).view(np.int32)


def features(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, k1, k2, tokens): size of the set, 128 bits of its content, minwise tokens; the last three null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                n, keys, tokens = [], [], []
                for s in shingle_sets(texts, k):
                    n.append(len(s))
                    h = mix(s ^ U(0x5851F42D4C957F2D))
                    keys.append((int(np.add.reduce(s)), int(np.bitwise_xor.reduce(h))) if len(s) else (0, 0))
                    tokens.append(min_tokens(s) if len(s) else np.empty(0, np.int32))
                empty = np.array(n) == 0
                key = np.array(keys, U).view(np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)), pa.array(np.concatenate(tokens).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(np.array(n, np.int64)), pa.array(key[:, 0], mask=empty), pa.array(key[:, 1], mask=empty), lists], ["doc_id", "n", "k1", "k2", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, tokens array<int>")


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(id, places, set) of whole texts: docs(id, text, places) with the texts' sets; places go along as they are."""
    schema = T.StructType([docs.schema["id"], docs.schema["places"], T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                found = list(shingle_sets(texts, k))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), batch.column("places").slice(at, len(texts)), lists], ["id", "places", "set"])

    return docs.mapInArrow(run, schema)


def linked(sets: list[np.ndarray], probe: np.ndarray, percent: int) -> np.ndarray:
    """Boolean matrix: which pairs with at least one probe have 100 * intersection >= percent * union."""
    size = np.array([len(s) for s in sets], np.int64)
    value, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), size)
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    p = np.flatnonzero(probe)
    common = np.zeros((len(p), len(sets)), np.int64)
    for at in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(column, [at, at + 2048])
        has = np.zeros((len(sets), 2048), np.float32)
        has[owner[a:b], column[a:b] - at] = 1
        common += (has[p] @ has.T).astype(np.int64)
    out = np.zeros((len(sets), len(sets)), bool)
    out[p] = 100 * common >= percent * (size[p][:, None] + size[None, :] - common)
    out |= out.T
    np.fill_diagonal(out, False)
    return out


def forest(link: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """For each component of the links an edge from its smallest id to each other id."""
    left, edges = link.any(1), []
    while left.any():
        seen = np.zeros(len(ids), bool)
        front = np.zeros(len(ids), bool)
        front[np.flatnonzero(left)[0]] = True
        while front.any():
            seen |= front
            front = link[front].any(0) & ~seen
        own = np.unique(ids[seen])
        edges += [(int(own[0]), int(x)) for x in own[1:]]
        left &= ~seen
    return edges


def agreeing(tokens: np.ndarray, probe: np.ndarray, comp: np.ndarray, least: int) -> np.ndarray:
    """Which rows of a group share `least` minwise tokens with a row of another component, one of the two being a probe."""
    p = np.flatnonzero(probe)
    keep = np.zeros(len(tokens), bool)
    step = max(1, (1 << 18) // (len(tokens) * COORDINATES))
    if step >= len(p) or step >= 16:
        parts = [(p[at : at + step], (tokens[p[at : at + step], None] == tokens[None]).sum(2)) for at in range(0, len(p), step)]
    else:
        same = np.zeros((len(p), len(tokens)), np.int16)
        for j in range(COORDINATES):
            same += tokens[p, j][:, None] == tokens[None, :, j]
        parts = [(p, same)]
    for own, same in parts:
        good = (same >= least) & (comp[own][:, None] != comp[None])
        keep |= good.any(0)
        keep[own] |= good.any(1)
    return keep


def alike(groups: DataFrame, tokens: DataFrame, least: int) -> DataFrame:
    """The rows of groups (gid, id, probe, comp) that share `least` minwise tokens with a row of their group in another component,
    one of the two being a probe. What cannot be linked, or is already, need not meet with its full set."""

    def chosen(t: pa.Table) -> pa.RecordBatch:
        gid, probe, comp = (t.column(c).to_numpy() for c in ("gid", "probe", "comp"))
        values = t.column("tokens").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        edge = np.flatnonzero(np.diff(gid)) + 1
        begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(gid)]])
        keep = np.zeros(len(gid), bool)
        two = begin[end - begin == 2]  # most groups are pairs
        good = ((values[two] == values[two + 1]).sum(1) >= least) & (comp[two] != comp[two + 1]) & (probe[two] | probe[two + 1])
        keep[two[good]] = keep[two[good] + 1] = True
        for a, b in zip(begin, end):
            if b - a > 2:
                keep[a:b] = agreeing(values[a:b], probe[a:b], comp[a:b], least)
        return t.select(["gid", "id", "probe"]).filter(pa.array(keep)).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            gid = t.column("gid").to_numpy()
            last = int(np.searchsorted(gid, gid[-1])) if len(gid) else 0  # the last group may go on in the next batch
            rest = t.slice(last)
            if last:
                yield from chosen(t.slice(0, last)).to_batches()
        if rest is not None and rest.num_rows:
            yield from chosen(rest).to_batches()

    # a number of partitions of its own: the groups cost time, not bytes, by which partitions would be put together
    met = groups.join(tokens, "id").select("gid", "id", "probe", "comp", "tokens").repartition(partitions(groups.sparkSession), "gid").sortWithinPartitions("gid")
    return met.mapInArrow(run, "gid long, id long, probe boolean")


def stars(pairs: DataFrame, block: int) -> DataFrame:
    """(gid, id, probe): pairs (y, id) as groups of one probe y and about `block` others."""
    dealt = pairs.join(pairs.groupBy("y").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "y")
    dealt = dealt.select("y", "id", F.pmod(F.xxhash64("id", F.lit(3)), "blocks").alias("block"))
    gid = F.xxhash64(F.lit(-1), "y", "block").alias("gid")
    return dealt.select(gid, "id", F.lit(False).alias("probe")).unionAll(dealt.select("y", "block").distinct().select(gid, F.col("y").alias("id"), F.lit(True).alias("probe")))


def confirmed(pool: DataFrame, texts: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Confirmed links (a, b) inside groups of (gid, id, probe): every probe against every member, on the full sets of texts (id,
    text). Each text that is needed is cut into shingles once; its set goes to its groups and is kept nowhere else."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = []
        if len(pdf) == 2:
            (a, b), (x, y) = pdf["set"], pdf["id"]
            common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
            edges = [(min(x, y), max(x, y))] if 100 * common >= percent * (len(a) + len(b) - common) and pdf["probe"].any() else []
        elif len(pdf) > 2:
            edges = forest(linked([np.asarray(s, np.int64) for s in pdf["set"]], pdf["probe"].to_numpy(), percent), pdf["id"].to_numpy())
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    places = scratch.keep(pool.groupBy("id").agg(F.collect_list(F.struct("gid", "probe")).alias("places")))
    sets = sets_of(joined(texts, places, "id", pool.count()), k).select("id", F.explode("places").alias("x"), "set").select("id", "x.gid", "x.probe", "set")
    links = scratch.keep(sets.repartition(partitions(texts.sparkSession), "gid").groupBy("gid").applyInPandas(run, "a long, b long"))
    scratch.drop(places)
    return links


def _content() -> list:
    """Numbers that tell groups of different members apart."""
    return [F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y"), F.min("id").alias("lo"), F.max("id").alias("hi")]


def _once(groups: DataFrame, key: str) -> DataFrame:
    """The keys of groups with two members and more; one key of those that have the same members."""
    return groups.groupBy("n", "x", "y", "lo", "hi").agg(F.min(key).alias(key)).select(key)


def _central(members: DataFrame, tokens: DataFrame) -> DataFrame:
    """(node, leader): the member whose tokens' lowest bits agree most with the majority of its node, the smallest id of
    those."""
    bits = members.select("node", "id").join(tokens, "id").select("node", "id", *[F.get("tokens", F.lit(j)).bitwiseAND(1).alias(f"b{j}") for j in range(COORDINATES)])
    major = bits.groupBy("node").agg(*[(2 * F.sum(f"b{j}") > F.count("*")).cast("int").alias(f"m{j}") for j in range(COORDINATES)])
    score = sum((F.col(f"b{j}") == F.col(f"m{j}")).cast("int") for j in range(COORDINATES))
    best = bits.join(major, "node").select("node", score.alias("score"), "id").groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("x"))
    return best.select("node", F.col("x.id").alias("leader"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) for each end of an edge, root being the smallest id that it reaches. Edges have a < b, or are dropped."""

    def neighbours(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def large(e: DataFrame) -> DataFrame:
        n = neighbours(e)
        low = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return n.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("b").agg(F.min("a").alias("m"))
        return e.join(low, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"), F.col("b").alias("c")).select("a", F.explode(F.array_distinct(F.array("b", "c"))).alias("b")).where("a < b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    now = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    was = state(now)
    while was[0]:
        new = scratch.keep(small(large(now)))
        scratch.drop(now)
        now, seen = new, state(new)
        if seen == was:
            break
        was = seen
    return now.select(F.col("b").alias("id"), F.col("a").alias("root")).unionAll(now.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())


def _open_with_all(large: DataFrame, level: int, block: int) -> DataFrame:
    """Groups (gid, id, probe, comp) of large(node, id, comp, n, r, open) in which each open member of a node meets each other
    member as a probe: a group is one block of all members and one part of the open ones."""
    blocks, parts = F.ceil(F.col("n") / block).cast("int"), F.ceil(F.col("r") / block).cast("int")
    dealt = large.select("*", blocks.alias("blocks"), parts.alias("parts")).select("*", F.pmod(F.xxhash64("id", F.lit(3)), "blocks").cast("int").alias("block"), F.pmod(F.xxhash64("id", F.lit(5)), "parts").cast("int").alias("part"))
    each_part, each_block = F.sequence(F.lit(0), F.col("parts") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)
    others = dealt.select("node", "id", "comp", "block", F.explode(F.when(F.col("open"), F.array_except(each_part, F.array("part"))).otherwise(each_part)).alias("part"), F.lit(False).alias("probe"))
    probes = dealt.where("open").select("node", "id", "comp", F.explode(each_block).alias("block"), "part", F.lit(True).alias("probe"))
    return others.unionByName(probes).select(F.xxhash64(F.lit(level), "node", "block", "part").alias("gid"), "id", "probe", "comp")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, trees: int = 8, branches: int = 3, small: int = 256, block: int = 1024, open_pairs: int = 1 << 24, depth: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text).

    n_shingles: size of the set of k-word shingles over words of lower-cased (A-Z) text; with fewer words the whole sequence is
    the one shingle. Null and empty texts have an empty set and are linked with nothing. Links need 100 * intersection >=
    percent * union. component_id: smallest doc_id reachable. kept: doc_id = component_id. Repeated doc_ids count as one
    document, whose rows all come back. A row without doc_id is linked with nothing; its component_id is null and it is kept.
    Other columns are ignored. trees, branches: see the module. small: members of a node that is compared exhaustively; block:
    rows that a larger node sends to one task, twice. open_pairs, depth: a larger node ends when its members outside the main
    component times all are so few, or at this depth; then these members are compared with all, in blocks.

    Pairs are confirmed on full sets only if they agree in enough minwise tokens (36 of 64 for 80 percent, which a pair at the
    threshold misses with a probability of some 1e-6).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    feats = scratch.keep(features(docs, k))
    classes = scratch.keep(feats.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("id")))
    reps = scratch.keep(feats.select(F.col("doc_id").alias("id"), "k1", "k2", "tokens").join(classes, ["k1", "k2", "id"]).select("id", "tokens").dropDuplicates(["id"]))
    rows_of = scratch.keep(feats.drop("tokens"))
    scratch.drop(feats)
    share = percent / 100
    least = max(1, int(COORDINATES * share - 4.8 * (COORDINATES * share * (1 - share)) ** 0.5))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    if not rows_of.where("n > 0").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        texts = texts.dropDuplicates(["id"])

    own = reps.select("id", F.posexplode(F.slice("tokens", 1, trees)).alias("tree", "value")).select(F.xxhash64(F.lit(0), "tree", "value").alias("node"), "tree", "id")
    rows = scratch.keep(own.join(own.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "node"))

    # the first tree: small nodes exhaustively, large ones around their most central member
    tree = rows.where("tree = 0")
    groups = tree.where(F.col("n") <= small).select(F.col("node").alias("gid"), "id", F.lit(True).alias("probe"))
    members = tree.where(F.col("n") > small)
    led = _central(members, reps)
    groups = groups.unionAll(stars(members.join(led, "node").where("id != leader").select(F.col("leader").alias("y"), "id").distinct(), block))
    pool = scratch.keep(alike(groups.withColumn("comp", F.col("id")), reps, least))
    links = [confirmed(pool, texts, k, percent, scratch)]
    root = components(links[0], scratch)
    scratch.drop(pool)

    # then what is still apart, in all trees
    now = rows.where((F.col("tree") > 0) | (F.col("n") > small)).select("node", "id")
    near, temporary = [], []
    for level in range(depth + 1):
        labelled = now.join(root, "id", "left").select("node", "id", F.coalesce("root", "id").alias("comp"))
        stats = scratch.keep(labelled.groupBy("node").agg(*_content(), F.min("comp").alias("c"), F.max("comp").alias("d")).where("c != d"))
        state = scratch.keep(labelled.join(stats.select("node", "n"), "node"))
        alone = state.join(_once(stats.where(F.col("n") <= small), "node"), "node")
        meet = alone.select(F.xxhash64(F.lit(level), "node").alias("gid"), "id", F.lit(True).alias("probe"), "comp")
        large = state.where(F.col("n") > small)
        main = large.groupBy("node", "comp").agg(F.count("*").alias("m")).groupBy("node").agg(F.max(F.struct("m", "comp")).alias("x"))
        large = large.join(main.select("node", F.col("x.comp").alias("main"), F.col("x.m").alias("m")), "node")
        large = scratch.keep(large.select("node", "id", "comp", "n", (F.col("n") - F.col("m")).alias("r"), (F.col("comp") != F.col("main")).alias("open")))
        ends = F.lit(level == depth) | (F.col("r") * F.col("n") <= open_pairs)
        meet = meet.unionByName(_open_with_all(large.where(ends), level, block))
        near.append(scratch.keep(alike(meet, reps, least)))
        more = large.where(~ends).select("node", "id").join(reps, "id")
        choice = F.transform(F.sequence(F.lit(1), F.lit(branches)), lambda i: F.pmod(F.xxhash64("node", i), F.lit(COORDINATES)).cast("int"))
        more = more.select("node", "id", "tokens", F.explode(F.array_distinct(choice)).alias("coordinate"))
        now = scratch.keep(more.select(F.xxhash64("node", "coordinate", F.get("tokens", "coordinate")).alias("node"), "id"))
        temporary += [state, stats, large, now]
        if now.isEmpty():
            break
    pool = near[0]
    for more in near[1:]:
        pool = pool.unionAll(more)
    pool = scratch.keep(pool.join(_once(pool.groupBy("gid").agg(*_content()), "gid"), "gid"))
    links.append(confirmed(pool, texts, k, percent, scratch))
    root = components(links[0].unionAll(links[1]), scratch)
    scratch.drop(pool, *near, *temporary)

    of_class = classes.join(root, "id", "left").select("k1", "k2", F.coalesce("root", "id").alias("root"))
    scratch.drop(reps, rows, *links)
    out = rows_of.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2").join(of_class, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
