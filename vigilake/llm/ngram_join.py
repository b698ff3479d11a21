"""N-gram Jaccard join by a token-group matrix, and the components of its links.

A document is its set of distinct word n-grams (64-bit hashes). Documents of equal sets are
one class. Tokens have one global order, rare ones first; two sets of the wanted similarity
share a token of their prefixes in that order, so prefixes alone decide who can meet.
Classes of the same least hash are likely similar and form a group, bounded in tokens. The
matrix holds the (token, group) pairs of the prefixes: a class is a query to each larger
group that shares a prefix token with it and has members of a fitting size, so a large group
is never sent to the small ones, and only if they share enough of their prefixes. Most prefix
tokens occur once; they pass one shuffle, packed to token and class, and end there. Where a
group lies, its token union is built once; a query that shares too few tokens with the union
does not open it. In an opened group members are
verified by exact overlap, and only links that connect something new are passed on. Every
link between different sets is thus found or implied, while copies are never expanded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, stored, texts_of
from .components import connected

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Frequent tokens put last in the order, most. Fewer or more change the work, never the links.
HOT_TOKENS = 200_000
#: Bits of the map of documents whose texts are needed again: a table of at most 65,536 rows.
MAP_BITS = 22
#: Hashes that a task counts at once.
BUFFER = 4_000_000


def shingles(texts: list[str], n: int) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's word n-grams; of all its words where it has fewer."""
    digest = xxhash.xxh64_intdigest
    out = []
    for t in texts:
        words = t.encode().lower().split()
        w = np.fromiter(map(digest, words), np.uint64, len(words))
        if not len(w):
            out.append(w)
            continue
        k = min(n, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = (h ^ w[i : len(w) - k + 1 + i]) * MIX
            h ^= h >> np.uint64(29)
        out.append(np.unique(h))
    return out


def needed(size: int, percent: int) -> int:
    """Least overlap with a set of `size` that the similarity allows."""
    return -(-percent * size // 100)


def least_shared(n: Column, low: Column, high: Column, percent: int) -> Column:
    """Least number of prefix tokens that a set of n shares with a linked one of low to high tokens.

    Of two sets take the one whose prefix ends first in the order: those of its prefix tokens that the other has lie
    in the other's prefix too. So the overlap is at most its size without its prefix and what the prefixes share. The
    overlap that a link needs, less that, is least at the sizes farthest from n; 2 allows for rounding.
    """
    small = F.greatest(low, F.ceil(percent * n / 100))
    large = F.least(high, F.floor(100 * n / percent))

    def at(m: Column) -> Column:
        return F.ceil(percent * (n + m) / (100 + percent)) - F.ceil(percent * F.greatest(n, m) / 100) - 1

    return F.greatest(F.lit(1), F.least(at(small), at(large)))


class Order:
    """The global order of tokens: by hash, the frequent ones after all others by ascending frequency."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens = tokens[by]
        self.rank = np.empty(len(tokens), np.int64)
        self.rank[np.lexsort((tokens[by], counts[by]))] = np.arange(len(tokens))

    def prefix(self, own: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
        """The first tokens of a set in the order, and how many of them are not frequent."""
        size = len(own) - needed(len(own), percent) + 1
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
            hot = self.tokens[at] == own
            if hot.any():
                cold = own[~hot]
                if len(cold) < size:
                    return np.concatenate([cold, own[hot][np.argsort(self.rank[at[hot]])]])[:size], len(cold)
                own = cold
        return own[:size], size


def packed(tokens: np.ndarray) -> bytes:
    """The upper six bytes of each token. Tokens that they confuse may open a group in vain, they never hide a link."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<i8")


def frequent_tokens(docs: DataFrame, n: int, most: int = HOT_TOKENS) -> Order:
    """Tokens that many documents have; a task reports those it meets twice in a buffer."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            some = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[some].view(np.int64)), pa.array(counts[some])], ["token", "n"])

        for b in batches:
            for own in shingles(texts_of(b), n):
                held.append(own)
                size += len(own)
                if size >= BUFFER:
                    yield out()
                    size = 0
        if held:
            yield out()

    found = docs.select("text").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.filter(F.col("n") >= 16).orderBy(F.col("n").desc(), "token").limit(most).toPandas()
    return Order(rows.token.to_numpy(np.int64).view(np.uint64), rows.n.to_numpy(np.int64))


def signatures(docs: DataFrame, order: Order, n: int, percent: int) -> DataFrame:
    """row (unique), doc_id, key (of the text), n_shingles, sig (of the set), least (hash), prefix (packed tokens), rare (its tokens that are not frequent).

    Row numbers hold as long as the result is not computed anew: it is to be stored.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingles(texts_of(b), n)
            prefixes = [order.prefix(s, percent) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([int(s[:1].view(np.int64)[0]) if len(s) else None for s in sets], pa.int64()),
                    pa.array([packed(x[0]) if x else None for x in prefixes], pa.binary()),
                    pa.array([x[1] if x else None for x in prefixes], pa.int32()),
                ],
                ["doc_id", "key", "n_shingles", "sig", "least", "prefix", "rare"],
            )

    found = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(signed, "doc_id long, key long, n_shingles long, sig binary, least long, prefix binary, rare int")
    return found.withColumn("row", F.monotonically_increasing_id())


def _exploded(classes: DataFrame, frequent: bool) -> DataFrame:
    """(token, node, home) of the classes' prefixes: of the frequent tokens or of the others."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rare = b.column("rare").to_pylist()
            tokens = [unpacked(x)[r:] if frequent else unpacked(x)[:r] for x, r in zip(b.column("prefix").to_pylist(), rare, strict=True)]
            if tokens:
                at = pa.array(np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), b.column("node").take(at), b.column("home").take(at)], ["token", "node", "home"])

    return classes.select("node", "home", "prefix", "rare").mapInArrow(each, "token long, node long, home long")


def _shared(cells: DataFrame) -> DataFrame:
    """The cells of tokens that lie in two groups. home 0 is a group of one class.

    Frequent tokens do not come here, so a token's rows are few against all rows.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((3, 0), np.int64)
        for last, b in _and_last(batches):
            if b is not None:
                rest = np.hstack([rest, np.stack([b.column(c).to_numpy() for c in ("token", "node", "home")])])
            # a token that ends the batch may go on in the next
            end = rest.shape[1] if last else int(np.searchsorted(rest[0], rest[0, -1])) if rest.shape[1] else 0
            token, node, home = own = rest[:, :end]
            rest = rest[:, end:]
            if end:
                start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
                count = np.diff(np.append(start, end))
                one_home = (np.maximum.reduceat(home, start) == np.minimum.reduceat(home, start)) & (home[start] != 0)
                own = own[:, np.repeat((count > 1) & ~one_home, count)]
                yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1])], ["token", "node"])

    return cells.repartition("token").sortWithinPartitions("token").mapInArrow(met, "token long, node long")


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    for b in batches:
        yield False, b
    yield True, None


class Group:
    """Sets with the union of their tokens and, for each token, the members that have it."""

    def __init__(self, members: list[np.ndarray], percent: int):
        self.percent, self.members = percent, members
        self.sizes = np.array([len(s) for s in members])
        owner, flat = np.repeat(np.arange(len(members)), self.sizes), np.concatenate(members)
        by = np.argsort(flat, kind="stable")
        self.union, start = np.unique(flat[by], return_index=True)
        self.start, self.owner = np.append(start, len(flat)), owner[by]
        self.label = np.arange(len(members))

    def similar(self, own: np.ndarray, outside: np.ndarray | None = None) -> np.ndarray:
        """Places of the members, or of those `outside`, that link with the set `own`."""
        at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
        at = at[self.union[at] == own]
        if len(at) < needed(len(own), self.percent):
            return np.empty(0, np.int64)  # the bound: no member can share enough
        first, count = self.start[at], self.start[at + 1] - self.start[at]
        total = int(count.sum())
        if outside is not None and 4 * int(self.sizes[outside].sum()) < total:
            flat = np.concatenate([self.members[j] for j in outside])
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            overlap = np.bincount(np.repeat(outside, self.sizes[outside])[own[at] == flat], minlength=len(self.sizes))
        else:
            places = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
            overlap = np.bincount(self.owner[places], minlength=len(self.sizes))
        return np.flatnonzero((overlap > 0) & (100 * overlap >= self.percent * (len(own) + self.sizes - overlap)))

    def within(self) -> list[tuple[int, int]]:
        """Links among the members that connect something new."""
        out, label = [], self.label
        for i, own in enumerate(self.members):
            outside = np.flatnonzero(label != label[i])
            if not len(outside):
                break
            for j in self.similar(own, outside).tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
        return out

    def across(self, own: np.ndarray) -> list[int]:
        """One member that links with `own` of each component of members."""
        found = self.similar(own)
        return found[np.unique(self.label[found], return_index=True)[1]].tolist()


def text_classes(signed: DataFrame) -> DataFrame:
    """sig, node, doc, n, least of every set: node is the number of its first row, doc its least doc_id. Rows without doc_id or n-grams are left out."""
    usable = signed.filter(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
    return usable.groupBy("sig").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc"), F.min("n_shingles").alias("n"), F.min("least").alias("least"))


def links(signed: DataFrame, docs: DataFrame, n: int, percent: int, group_tokens: int = 1_000_000) -> DataFrame:
    """(a, b): links between nodes of text_classes(signed); enough of them to connect all that is linked."""
    classes = text_classes(signed)
    # a group is cut by size; its name begins with the size, so that names order groups by it
    sizes = classes.groupBy("least").agg(F.sum("n").alias("tokens"), F.count("*").alias("members"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("tokens") / group_tokens))
    name = F.shiftleft(F.floor(F.log2("tokens")), 56) + F.pmod(F.xxhash64("least", part), F.lit(1 << 56))
    named = classes.join(sizes, "least").select("node", "n", name.alias("group"), F.when(F.col("members") == 1, 0).otherwise(name).alias("home"))
    # a class is known by one of its rows, whose id and text's key tell where its text lies
    grouped = stored(named.join(signed.select(F.col("row").alias("node"), "doc_id", "key"), "node"))
    # the matrix: tokens of one group alone open nothing
    prefixes = signed.select(F.col("row").alias("node"), "prefix", "rare").join(grouped.select("node", "home"), "node")
    cells = _shared(_exploded(prefixes, False)).unionByName(_exploded(prefixes, True).select("token", "node"))
    rows = stored(cells.join(grouped.select("node", "n", "group"), "node"))
    spans = rows.groupBy("token", F.col("group").alias("g")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    fits = (F.col("g") > F.col("group")) & (100 * F.col("high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("low"))
    met = rows.join(spans, "token").filter(fits).groupBy("node", "n", "g").agg(F.count("*").alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"))
    asked = stored(met.filter(F.col("shared") >= least_shared(F.col("n"), F.col("low"), F.col("high"), percent)).select("node", "n", "g"))
    # the queries of a group are dealt to chunks of bounded size, each of which gets the group
    chunks = asked.groupBy("g").agg(F.ceil(F.sum("n") / group_tokens).cast("int").alias("chunks"))
    members = grouped.groupBy("group").count().join(chunks, F.col("group") == F.col("g"), "left").filter((F.col("count") > 1) | F.col("chunks").isNotNull())
    members = members.select(F.col("group").alias("g"), F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"))
    queries = asked.join(chunks, "g").select("node", "g", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"))
    at_home = grouped.select("node", F.col("group").alias("g")).join(members, "g").select("node", "g", "chunk", F.lit(0).alias("side"))
    wanted = stored(at_home.unionByName(queries))

    # the texts of the documents that take part, by a map of bounded size and then by id
    def cell(c: str):
        return F.pmod(F.xxhash64(c), F.lit(1 << MAP_BITS)).cast("int")

    wanted = wanted.join(grouped.select("node", "doc_id", "key"), "node").withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    marked = wanted.select(F.shiftright(cell("_doc"), 6).alias("_w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(_doc), {1 << MAP_BITS}) as int) & 63)").alias("bit")).groupBy("_w").agg(F.bit_or("bit").alias("_bits"))
    again = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("key"), F.shiftright(cell("doc_id"), 6).alias("_w"))
    again = again.join(F.broadcast(marked), "_w").filter(F.getbit("_bits", cell("doc_id").bitwiseAND(F.lit(63))) == 1).select("doc_id", "key", "text")
    met = again.join(wanted, (F.col("doc_id") == F.col("_doc")) & (F.col("key") == F.col("_key"))).select("g", "chunk", "side", "node", "text")
    dealt = met.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "side", "node")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for block in runs(batches, ["g", "chunk"]):
            side, nodes = block.column("side").to_pylist(), block.column("node").to_pylist()
            sets = shingles(texts_of(block), n)
            own = [i for i, (s, x) in enumerate(zip(side, sets, strict=True)) if s == 0 and len(x)]
            if not own:
                continue
            group = Group([sets[i] for i in own], percent)
            got = [(nodes[own[i]], nodes[own[j]]) for i, j in group.within()]
            for i, (s, x) in enumerate(zip(side, sets, strict=True)):
                if s == 1 and len(x):
                    got += [(nodes[i], nodes[own[j]]) for j in group.across(x)]
            left += [a for a, _ in got]
            right += [b for _, b in got]
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(verified, "a long, b long").distinct()


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, key (the text's hash), n_shingles, component (null without n-grams or doc_id), component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = frequent_tokens(docs, n)
    signed = stored(signatures(docs, order, n, percent))
    found = connected(links(signed, docs, n, percent))
    classes = text_classes(signed).select("sig", "node", "doc").join(found, "node", "left").select("sig", "doc", F.coalesce("component", "node").alias("component"))
    least = classes.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = classes.join(least, "component").select("sig", "component", "component_id")
    rows = signed.select("doc_id", "key", "n_shingles", "sig").join(named, "sig", "left")
    known = F.col("doc_id").isNotNull()
    return rows.select("doc_id", "key", "n_shingles", F.when(known, F.col("component")).alias("component"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"))


def join_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    Two rows link when 100 * shared >= percent * united n-grams; component_id is the least doc_id that
    links reach. A null or empty text, or one without words, has no n-grams and links with nothing.
    Rows that share a doc_id are rows of their own: they are not linked by it, though components that
    do not meet may then have the same component_id. A null doc_id has no component.
    """
    return _components(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Of each component one row, of its least doc_id, all columns as they are.

    Where several rows of a component have that doc_id one of them stays. Rows without doc_id, and rows
    without n-grams, link with nothing and all stay.
    """
    rows = _components(docs, n, percent)
    texts = rows.filter(F.col("doc_id") == F.col("component_id")).filter(F.col("component").isNotNull()).groupBy("component", "component_id", "key").agg(F.count("*").alias("n"))
    first = texts.groupBy("component").agg(F.min("component_id").alias("_doc"), F.min(F.struct("key", "n")).alias("_text")).select("_doc", F.col("_text.key").alias("_key"), F.col("_text.n").alias("_n"))
    worded = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))

    def held(wanted: DataFrame) -> DataFrame:
        on = (F.col("doc_id").cast("long") == wanted["_doc"]) & (F.xxhash64("text") == wanted["_key"])
        return docs.filter(worded).join(wanted, on, "left_semi")

    # only rows that repeat both their id and their text have to meet
    one, several = first.filter("_n = 1").select("_doc", "_key"), first.filter("_n > 1").select("_doc", "_key")
    return held(one).unionByName(held(several).dropDuplicates(["doc_id", "text"])).unionByName(docs.filter(~worded))


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under 0.8 similarity of word 5-grams."""
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

