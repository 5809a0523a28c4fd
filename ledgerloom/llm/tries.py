"""Similarity join of short texts within a bounded number of typing errors.

Texts are dealt to shards by the pieces they are made of.  Of the ``k + 1``
pieces of a text with at most ``k`` errors there is a first one, the i-th, with no
error of its own, exactly i errors before it and at most ``k - i`` behind, when an
exchange across two pieces counts for the first of them.  So it stands at most i
places away seen from the front and ``k - i`` seen from the end, and the only
damage it can have is its first letter exchanged with the letter before it, which
the asking side undoes in a further key.  No pair within the bound is lost.  Each
shard's texts form a trie, which a Levenshtein automaton (with neighbouring
letters exchanged as one error) walks for every asking text, so that common
beginnings are worked out once and hopeless branches never.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import bounded, written

#: Asking rows of a shard that holds more rows than this are spread over several tasks; rows are counted at one in so many texts.
HOT_ROWS, SALTS, COUNTED = 20_000, 16, 16


def errors_allowed(length: int) -> int:
    """Bound of the distance for a text of so many letters."""
    return 0 if length < 4 else 1 if length < 7 else 2


class Trie:
    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, text: str, value) -> None:
        node = self.root
        for c in text:
            node = node.setdefault(c, {})
        node.setdefault("", []).append((text, value))

    def within(self, text: str, k: int) -> Iterator[tuple[str, object, int]]:
        """All ``(text, value, distance)`` within ``k`` errors of ``text``.

        Of each row of the automaton only the cells within ``k`` of the diagonal
        are worked out, as the others are above ``k`` anyway.
        """
        n, far = len(text), k + 1
        stack = [(self.root, [j if j <= k else far for j in range(n + 1)], None, "", 0)]
        while stack:
            node, row, above, last, depth = stack.pop()
            if "" in node and row[n] <= k:
                for known, value in node[""]:
                    yield known, value, row[n]
            depth += 1
            if depth > n + k:
                continue
            low, high = max(1, depth - k), min(n, depth + k)
            still = min(row) <= k - 1  # an exchange may yet follow
            for c, child in node.items():
                if not c:
                    continue
                new = [far] * (n + 1)
                if depth <= k:
                    new[0] = depth
                least = new[0]
                for j in range(low, high + 1):
                    t = text[j - 1]
                    d = row[j - 1] if t == c else 1 + min(row[j - 1], row[j], new[j - 1])
                    if above is not None and j > 1 and t == last and text[j - 2] == c and above[j - 2] + 1 < d:
                        d = above[j - 2] + 1
                    if d < far:
                        new[j] = d
                        if d < least:
                            least = d
                if least <= k or still:
                    stack.append((child, new, row, c, depth))


def _pieces(length: int, k: int) -> list[tuple[int, int]]:
    """Begin and end of ``k + 1`` pieces of about the same size."""
    cuts = [round(i * length / (k + 1)) for i in range(k + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def indexed_keys(text: str) -> list[str]:
    """A key for each piece."""
    n = len(text)
    return [f"{n}\t{i}\t{text[a:e]}" for i, (a, e) in enumerate(_pieces(n, errors_allowed(n)))]


def asking_keys(text: str, longest: int | None = None) -> set[str]:
    """The keys under which every text within the bound is found.

    ``longest``: only texts of up to so many letters are looked for.
    """
    m, keys = len(text), set()
    for n in range(max(1, m - errors_allowed(m)), min(m + errors_allowed(m), m + 2 if longest is None else longest) + 1):
        k, more = min(errors_allowed(m), errors_allowed(n)), m - n
        if abs(more) > k:
            continue
        for i, (a, e) in enumerate(_pieces(n, errors_allowed(n))[: k + 1]):
            head = f"{n}\t{i}\t"
            for d in range(max(-i, more - (k - i)), min(i, more + (k - i)) + 1):
                at, to = a + d, e + d
                if at < 0 or to > m:
                    continue
                keys.add(head + text[at:to])
                if at and abs(d) < i:  # the exchange is one of the i errors before
                    keys.add(head + text[at - 1] + text[at + 1 : to])
    return keys


def _shards(batches: Iterator[pa.RecordBatch], mutual: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for block, node, forms, indexed, asking in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if indexed and forms:
                out.extend((block, key, True, node, forms[0]) for key in indexed_keys(forms[0]))
            if asking:
                # of two that both ask and are indexed, the longer one asks
                for form in set(forms):
                    out.extend((block, key, False, node, form) for key in asking_keys(form, len(form) if mutual else None))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()), strict=True)], names=["block", "key", "indexed", "node", "form"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, those to be indexed first; a shard's trie is made when a text asks for others than itself."""
    shard, held, tries = None, {}, {}
    for b in batches:
        out: list[tuple] = []
        for key, salt, block, indexed, node, form in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if (key, salt) != shard:
                shard, held, tries = (key, salt), {}, {}
            if indexed:
                held.setdefault(block, []).append((form, node))
            elif (texts := held.get(block)) and (len(texts) > 1 or texts[0][1] != node):
                trie = tries.get(block)
                if trie is None:
                    trie = tries[block] = Trie()
                    for text, value in texts:
                        trie.add(text, value)
                k = errors_allowed(len(form))
                out.extend((node, other, d) for known, other, d in trie.within(form, k) if other != node and d <= errors_allowed(len(known)))
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["node", "near", "distance"])


def near(nodes: DataFrame, mutual: bool = False) -> DataFrame:
    """``(node, near, distance)`` of every asking node and every indexed node of its block within the bound.

    ``nodes(block, node, forms, indexed, asking)``: ``node`` is unique in its
    block, ``forms`` are its writings (permutations of its words), the first of
    which is indexed.  Pairs come once for each direction in which both are
    asking and indexed.  ``mutual``: all nodes are both, and have the same letters
    in every form; then only the longer of two asks.

    A shard is known by a hash of its key; its block is kept beside it, so that a
    clash of hashes links nothing.  Shards of more than about ``HOT_ROWS`` rows
    have their asking rows spread over ``SALTS`` tasks, each with the shard's trie;
    which ones are spread changes nothing in the result.
    """
    keyed = nodes.select(F.xxhash64("block").alias("block"), F.col("node").cast("long"), "forms", "indexed", "asking").mapInArrow(lambda it: _shards(it, mutual), "block long, key string, indexed boolean, node long, form string")
    shards = written(keyed.select(F.xxhash64("block", "key").alias("shard"), "block", "indexed", "node", "form"), "shards")
    counted = shards.where(F.pmod(F.xxhash64("node", F.lit("counted")), F.lit(COUNTED)) == 0)
    hot = bounded(written(counted.groupBy("shard").agg(F.count("*").alias("rows")).where(F.col("rows") * COUNTED > HOT_ROWS).select("shard", F.lit(True).alias("hot")), "hot-shards"))
    salt = F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS)).cast("int")
    salts = F.when(F.col("hot") & F.col("indexed"), F.sequence(F.lit(0), F.lit(SALTS - 1))).when(F.col("hot"), F.array(salt)).otherwise(F.array(F.lit(0)))
    dealt = shards.join(hot, "shard", "left").select("shard", F.explode(salts).alias("salt"), "block", "indexed", "node", "form")
    sorted_ = dealt.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("indexed").desc())
    found = sorted_.mapInArrow(_search, "node long, near long, distance int")
    if mutual:
        both = F.explode(F.array(F.struct("node", "near"), F.struct(F.col("near").alias("node"), F.col("node").alias("near"))))
        found = found.select(both.alias("p"), "distance").select("p.node", "p.near", "distance")
    return found.groupBy("node", "near").agg(F.min("distance").alias("distance"))
