"""Near-duplicate join on word shingles: T-occurrence search with DivideSkip.

Two texts link when their shingle sets have a Jaccard similarity of at least ``percent`` / 100; documents
that reach each other by links are one component.

1. Texts with equal sets are one class, told apart by the set's 64-bit hash.
2. Every class posts the rarest of its shingles, as many as a linked class cannot all lack. Rarity comes from
   counts of all shingles in a table of fixed size, so that shingles that many texts share are posted only
   by texts that have little else.
3. Classes with a common posting form the cluster of the least of them: any two classes that can link are
   together in a cluster, and a cluster's rows are linear in its members.
4. Within a cluster, in blocks of bounded size, counts of a set's shingles by cell bound the overlap of any
   two members from above, so that whole sets travel only of classes that can reach the overlap T with
   another member; they travel as compressed words. Each class that is not yet connected to the cluster's least
   is a query: the short inverted lists are merged with a heap, the long ones probed by binary search, and
   classes that reach the overlap T are links. A pair that is already connected is not compared.
5. Clusters of more blocks than one: after components are joined, the classes still apart from the cluster's
   least are queries against each other block.

Edge cases: null texts and texts without words have an empty set and link with nothing. A row with a null id
names no component; its own is that of an equal set's rows, or null. Texts of fewer words than a shingle have one
shingle, the sequence. Texts of any length are read whole. Rows that repeat an id belong to one document if any:
they share a component. Similarities that tie with the threshold link. An empty table gives no rows. Extra columns
are ignored, whatever they are called, and kept by ``keep_first``.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, bit_filter, few_files, let_go, lowered_words, materialize, per_row, signed, small_batches, window_hashes, word_hashes

SKETCH_BITS = 20
#: A cluster's block: what one task holds of a cluster at once.
BLOCK = 1024
#: How many classes a task remembers so as not to post them again; more only post repeats.
SEEN = 100_000


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted hashes of the different shingles of a whole text."""
    return shingles_of(lowered_words(text), size)


def shingles_of(words: list[bytes], size: int) -> np.ndarray:
    base = word_hashes(words)
    if not len(base):
        return base
    if len(base) < size:  # the length goes in, so that no shorter sequence equals a full shingle
        return window_hashes(base, len(base)) + np.uint64(len(base))
    return np.unique(window_hashes(base, size))


def packed(words: list[bytes]) -> bytes:
    """Words as they travel: compressed they take a fraction of their set's 8 bytes a shingle."""
    return zlib.compress(b" ".join(words), 1)


def unpacked(words: bytes, size: int) -> np.ndarray:
    """The set of ``packed`` words; none of them holds white space."""
    return shingles_of(zlib.decompress(words).split(), size)


def set_hash(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def need(a: int, b: int, percent: int) -> int:
    """The least overlap of linked sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    """How many shingles are posted: a linked set has at least ceil(percent n / 100) of a set's n, so it
    cannot lack all of one more than the rest."""
    return n - -(-percent * n // 100) + 1


def links(a: int, b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def cells(found: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes by their top bits, in as many cells (a power of two) as suit its size."""
    bits = min(12, max(5, (len(found) // 8).bit_length()))
    return np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16)


class Bounds:
    """Upper bounds of overlaps: in each cell two sets share at most the smaller count."""

    def __init__(self, counts: list[np.ndarray]):
        self.sizes = np.array([int(c.sum()) for c in counts])
        self.order = np.argsort(self.sizes, kind="stable")
        self.sorted = self.sizes[self.order]
        self.counts = counts
        self.tables: dict[int, np.ndarray] = {}

    def folded(self, width: int) -> np.ndarray:
        """All counts in ``width`` cells; of sets that have fewer cells, nothing is known."""
        if width not in self.tables:
            table = np.full((len(self.counts), width), np.iinfo(np.uint16).max, np.uint16)
            for k, c in enumerate(self.counts):
                if len(c) >= width:
                    table[k] = c.reshape(width, -1).sum(1)
            self.tables[width] = table[self.order]
        return self.tables[width]

    def partners(self, counts: np.ndarray, percent: int) -> np.ndarray:
        """Places whose sizes and counts let them link with a set of these ``counts``."""
        n = int(counts.sum())
        low = np.searchsorted(self.sorted, -(-percent * n // 100))
        high = np.searchsorted(self.sorted, 100 * n // percent, side="right")
        if low >= high:
            return np.empty(0, np.int64)
        # a partner may have half the cells, so compare in half as many
        width = max(32, len(counts) // 2)
        mine = counts.reshape(width, -1).sum(1).astype(np.uint16)
        most = np.minimum(self.folded(width)[low:high], mine).sum(1, dtype=np.int64)
        wanted = -(-percent * (self.sorted[low:high] + n) // (100 + percent))
        return self.order[low:high][most >= wanted]


class Union:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        root = x
        while (up := self.up.get(root, root)) != root:
            root = up
        while (up := self.up.get(x, x)) != root:
            self.up[x] = root
            x = up
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class InvertedIndex:
    """Inverted lists (sorted member numbers) of the shingles of a block's sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order].tolist()
        self.tokens, starts = np.unique(tokens, return_index=True)
        self.starts = np.append(starts, len(tokens))

    def lists(self, query: np.ndarray) -> list[list[int]]:
        at = np.searchsorted(self.tokens, query)
        inside = at < len(self.tokens)
        at, query = at[inside], query[inside]
        at = at[self.tokens[at] == query]
        return [self.owner[self.starts[k] : self.starts[k + 1]] for k in at.tolist()]

    def search(self, query: np.ndarray, percent: int, skip) -> Iterator[int]:
        """Members that link with ``query`` (DivideSkip). The least size a linked member can have gives T;
        of the query's lists the T - 1 longest at most are set aside, so a member that reaches T is in a
        short list; short lists are heap-merged, and what a member still needs is probed in the long ones."""
        lists = sorted(self.lists(query), key=len)
        n = len(query)
        least = -(-percent * n // 100)
        t = need(n, least, percent)
        if len(lists) < t:
            return
        aside = min(t - 1, len(lists) - 1)
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        merged = heapq.merge(*short)
        member = next(merged, None)
        while member is not None:
            count, m = 0, member
            while member == m:
                count += 1
                member = next(merged, None)
            size = self.sizes[m]
            if size < least or percent * size > 100 * n or skip(m):
                continue
            wanted = need(n, size, percent)
            left = len(long)
            for one in long:
                if count >= wanted or count + left < wanted:
                    break
                at = bisect_left(one, m)
                count += at < len(one) and one[at] == m
                left -= 1
            if count >= wanted:
                yield m


def cluster_links(leader: tuple[int, np.ndarray] | None, ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs (least, other) that connect a block's members as all its links would, as stars: ``leader`` asks first,
    then each member that is not connected with it."""
    index, union = InvertedIndex(sets), Union()

    def ask(who: int, found: np.ndarray) -> None:
        for m in index.search(found, percent, lambda m: ids[m] == who or union.find(ids[m]) == union.find(who)):
            union.join(ids[m], who)

    if leader is not None:
        ask(*leader)
    for who, found in zip(ids, sets, strict=True):
        if leader is None or union.find(who) != union.find(leader[0]):
            ask(who, found)
    return [(union.find(x), x) for x in union.up]


def sketch(rows: DataFrame, size: int) -> np.ndarray:
    """Counts of all shingles of all rows in 2**SKETCH_BITS cells by hash; each task sends one table."""
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
    parts = 16

    def count(batches):
        table = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            found = [shingles(t, size) for t in batch.column(0).to_pylist()]
            if found:
                at = np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)
                table += np.bincount(at.astype(np.int64), minlength=len(table))
        if table.any():
            yield batches_of(schema, range(parts), [zlib.compress(c.astype(np.uint32).tobytes(), 1) for c in table.reshape(parts, -1)])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[p] = total.get(p, 0) + np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64)
        if total:
            yield batches_of(schema, list(total), [c.tobytes() for c in total.values()])

    summed = rows.select("text").mapInArrow(count, "part int, counts binary").repartition(parts, "part").mapInArrow(add, "part int, counts binary")
    table = np.zeros((parts, (1 << SKETCH_BITS) // parts), np.int64)
    for r in summed.collect():  # 2**SKETCH_BITS numbers
        table[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return table.ravel()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id that each id of ``edges`` (a, b) reaches. Alternating large-star and
    small-star steps on tables; the rounds grow with the logarithm of the longest path."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    pairs = materialize(few_files(pairs), "links")
    while not _stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # each link gives one row at most, so repeats may stay until the small star
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(few_files(large.where("u != v")), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = materialize(few_files(small.where("u != v").distinct()), "small-star")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _stars(pairs: DataFrame) -> bool:
    """Whether all paths are stars: no node has two lower ends, nor a lower end and a higher one."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below = 1 and above = 1").isEmpty()


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set, and the smallest id that its
    links reach."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def classes():
        let_go()  # workers that have served another operator come with its model

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingles(t, size) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([set_hash(x) if len(x) else None for x in found], pa.int64()), pa.array([cells(x).tobytes() if len(x) else None for x in found], pa.binary())], names=["doc_id", "n", "class", "cells"])

        return step

    members = materialize(few_files(rows.mapInArrow(per_row(classes), f"doc_id {kind}, n long, class long, cells binary")), "classes")
    first = members.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
    edges = class_links(rows, members, size, percent, block)
    # Ids that repeat tie their classes together too.
    repeated = members.where("class is not null and doc_id is not null").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a != b")
    if not repeated.isEmpty():
        least = repeated.select("doc_id", "a")
        edges = edges.unionByName(members.where("class is not null").join(least, "doc_id").select("a", F.col("class").alias("b")))
    roots = components(edges)
    # A component's name is the smallest id of its classes.
    named = first.join(roots, first["class"] == roots["id"], "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = named.join(smallest, "root").select("class", "component_id")
    return members.join(by_class, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def class_links(rows: DataFrame, members: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """(a, b): links between classes that connect them as all links would."""
    spark = rows.sparkSession
    order = spark.sparkContext.broadcast(sketch(rows, size))  # 2**SKETCH_BITS numbers
    schema = pa.schema([("token", pa.int64()), ("class", pa.int64())])

    def post(batches):
        counts, seen = order.value, set()
        for batch in batches:
            tokens, owners = [], []
            for t in batch.column(0).to_pylist():
                found = shingles(t, size)
                if len(found) and (own := set_hash(found)) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(own)
                    rare = np.lexsort((found, counts[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                    tokens.append(signed(found[rare[: prefix(len(found), percent)]]))
                    owners.append(np.full(len(tokens[-1]), own))
            if tokens:
                a, b = np.concatenate(tokens), np.concatenate(owners)
                for i in range(0, len(a), 100_000):
                    yield batches_of(schema, a[i : i + 100_000], b[i : i + 100_000])

    # Postings are most of what moves, so they are dealt once and not written.
    postings = rows.select("text").mapInArrow(post, "token long, class long")
    same = Window.partitionBy("token")
    shared = postings.select("class", F.min("class").over(same).alias("leader"), F.max("class").over(same).alias("last")).where("last > leader")
    clusters = materialize(few_files(shared.select("leader", "class").distinct()), "clusters")

    # Of each class in a cluster: a document that has it, and its counts by cell.
    wanted = clusters.select("class").distinct()
    facts = members.where("class is not null and doc_id is not null").join(wanted, "class", "left_semi")
    facts = materialize(few_files(facts.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("cells").alias("cells"))), "cluster-classes")

    sizes = clusters.groupBy("leader").agg(F.count("*").alias("members"))
    dealt = clusters.join(sizes, "leader").select("leader", "class", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    # a member is asked in its own block, the leader asks in every block
    blocks = F.when(F.col("class") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_block_of("class")))
    first = dealt.select("leader", F.explode(blocks).alias("block"), "class", (F.col("class") == F.col("leader")).alias("asks"))
    links = materialize(few_files(_linked(first, rows, facts, size, percent, None)), "links-first")

    many = dealt.where("blocks > 1 and class != leader")
    if many.isEmpty():
        return links
    # Clusters of several blocks: who is still apart from the leader asks in every block.
    roots = components(links)
    rooted = many.join(roots, many["class"] == roots["id"], "left").select("leader", "class", "blocks", F.coalesce("root", "class").alias("root"))
    heads = roots.select(F.col("id").alias("leader"), F.col("root").alias("head"))
    rooted = rooted.join(heads, "leader", "left").withColumn("head", F.coalesce("head", "leader"))
    rooted = materialize(few_files(rooted), "rooted")
    asking = rooted.where("root != head").select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "class", F.lit(True).alias("asks"), "root")
    asked = rooted.join(asking.select("leader").distinct(), "leader", "left_semi").select("leader", _block_of("class").alias("block"), "class", F.lit(False).alias("asks"), "root")
    again = materialize(few_files(_linked(asking.unionByName(asked), rows, facts, size, percent, "root")), "links-again")
    # what is connected already goes on as stars, so that it needs no further rounds
    return roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(again)


def _block_of(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.col("blocks")).cast("int")


def _linked(dealt: DataFrame, rows: DataFrame, facts: DataFrame, size: int, percent: int, root: str | None) -> DataFrame:
    able = materialize(few_files(_able(dealt, facts, percent, root)), "able")
    return _searched(able, _sets(able.select("class").distinct(), rows, facts, size), size, percent, root)


def _sets(wanted: DataFrame, rows: DataFrame, facts: DataFrame, size: int) -> DataFrame:
    """(class, words) of the wanted classes, packed. The bit filter passes few texts besides theirs."""
    key = F.xxhash64(F.col("doc_id").cast("string")).alias("h")
    maybe = bit_filter(facts.join(wanted, "class", "left_semi").select(key), "h")
    schema = pa.schema([("class", pa.int64()), ("words", pa.binary())])

    def whole_sets(batches):
        for batch in batches:
            seen = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            passed = batch.filter(pa.array(maybe.value.maybe(seen)))
            found = [(set_hash(shingles_of(words, size)), packed(words)) for t in passed.column(1).to_pylist() if (words := lowered_words(t))]
            if found:
                yield batches_of(schema, *zip(*found, strict=True))

    sets = rows.where("doc_id is not null").select(key, "text").mapInArrow(whole_sets, "class long, words binary")
    return sets.join(wanted, "class", "left_semi").groupBy("class").agg(F.first("words").alias("words"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first two columns, one group at a time."""
    key, group = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                if group:
                    yield key, group
                key, group = row[:2], []
            group.append(row[2:])
    if group:
        yield key, group


def _by_block(df: DataFrame) -> DataFrame:
    return df.repartition("leader", "block").sortWithinPartitions("leader", "block", F.desc("asks"), "class")


def _able(dealt: DataFrame, facts: DataFrame, percent: int, root: str | None) -> DataFrame:
    """The rows of ``dealt`` that some other row of their block may link with, by the bounds."""
    columns = ["leader", "block", "class", "asks", *([root] if root else [])]
    held = dealt.join(facts.select("class", "cells"), "class").select(*columns, "cells")
    types = [("leader", pa.int64()), ("block", pa.int32()), ("class", pa.int64()), ("asks", pa.bool_()), *([(root, pa.int64())] if root else [])]
    schema = pa.schema(types)

    def chosen(batches):
        done = []
        for key, group in _groups(batches):
            asked = [r for r in group if root is None or not r[1]]
            if len(asked) < 2 and root is None or not asked:
                continue
            asking = range(len(asked)) if root is None else [k for k, r in enumerate(group) if r[1]]
            bounds = Bounds([np.frombuffer(r[-1], np.uint16) for r in asked])
            into: set[int] = set()
            by: set[int] = set()
            for k in asking:
                who = asked[k] if root is None else group[k]
                near = [m for m in bounds.partners(np.frombuffer(who[-1], np.uint16), percent).tolist() if asked[m][0] != who[0] and (root is None or asked[m][2] != who[2])]
                if near:
                    by.add(k)
                    into.update(near)
            if root is None:
                done += [(*key, *asked[k][:-1]) for k in sorted(by | into)]
            else:
                done += [(*key, *group[k][:-1]) for k in sorted(by)] + [(*key, *asked[k][:-1]) for k in sorted(into)]
            if len(done) > 50_000:
                yield batches_of(schema, *zip(*done, strict=True))
                done = []
        if done:
            yield batches_of(schema, *zip(*done, strict=True))

    kinds = "leader long, block int, class long, asks boolean" + (f", {root} long" if root else "")
    return _by_block(held).mapInArrow(chosen, kinds)


def _searched(dealt: DataFrame, sets: DataFrame, size: int, percent: int, root: str | None) -> DataFrame:
    """Searches each (leader, block): rows that ask and rows that are asked. Rows stream through sorted, and
    a task holds one block at a time."""
    columns = ["leader", "block", "class", "asks", *([root] if root else [])]
    held = dealt.select(*columns).join(sets, "class").select(*columns, "words")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches):
        for _, group in _groups(batches):
            found = ask_first(group) if root is None else ask_all(group)
            if found:
                yield batches_of(schema, *zip(*found, strict=True))

    def parsed(rows):
        return [r[0] for r in rows], [unpacked(r[-1], size) for r in rows]

    def ask_first(group):
        heads, rest = [r for r in group if r[1]], [r for r in group if not r[1]]
        ids, sets = parsed(rest)
        leader = (heads[0][0], unpacked(heads[0][-1], size)) if heads else None
        return cluster_links(leader, ids, sets, percent)

    def ask_all(group):
        asked = [r for r in group if not r[1]]
        ids, sets = parsed(asked)
        index, union, out = InvertedIndex(sets), Union(), []
        roots = [r[2] for r in asked]
        for r in group:
            if r[1]:
                for m in index.search(unpacked(r[-1], size), percent, lambda m, r=r: union.find(roots[m]) == union.find(r[2])):
                    union.join(roots[m], r[2])
                    out.append((r[0], ids[m]))
        return out

    return _by_block(held).mapInArrow(search, "a long, b long")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows, unchanged, that are not near duplicates of a row with a smaller id: of each component the
    smallest id stays. Rows with a null id and rows that repeat the id that stays are kept."""
    found = join_components(docs, doc_id, text, size, percent)
    gone = found.where("component_id != doc_id").select("doc_id").distinct().withColumnRenamed("doc_id", "__gone")
    return few_files(docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti"))
