"""Near-duplicate classes by ProbMinHash.

Every weighted shingle of a text (five words; its weight is how often it stands there) sends arrivals, a Poisson process with its weight
as rate, to random registers; a register keeps the shingle that arrives first. Two texts agree in a register with
their probability Jaccard similarity. A shingle stops when its next arrival comes after the last register was filled. Bands of
registers give candidates, and what agrees there is verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import Words, column, gram_hashes, mix, pick, small_batches, spans, steps
from heddle.session import cut

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS = 128
#: Registers of a band: a pair of similarity 0.8 misses all 32 bands once in twenty million.
BAND = 4
#: Bands whose buckets are compared with one of their texts at first.
FIRST_BANDS = 8
#: Texts of a bucket that are compared with each other in one task.
BLOCK = 512
#: Agreeing registers below which a pair cannot be verified: 0.8 less five standard deviations.
LEAST_AGREEING = int(REGISTERS * (SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5))


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text: hashes, weights, and where each text's begin. A text of fewer words, but not none,
    is one shingle."""
    counts = words.counts()
    n = np.where(counts >= size, counts - size + 1, 0)
    hashes = words.hashes()
    grams = gram_hashes(hashes, size)[spans(words.first[:-1], n)]
    owner = np.repeat(np.arange(len(counts)), n)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        grams = np.concatenate([grams, [_of_short(hashes[words.first[i] : words.first[i + 1]]) for i in short]]).astype(np.uint64)
        owner = np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    weights = np.diff(np.append(at, len(grams)))
    return grams[at], weights, np.searchsorted(owner[at], np.arange(len(counts) + 1))


def _of_short(hashes: np.ndarray) -> np.uint64:
    return mix(gram_hashes(hashes, len(hashes)) + np.uint64(len(hashes)))[0]


def signatures(grams: np.ndarray, weights: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """For each text the shingle that came first in each register; 0 for texts without shingles."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    came = np.full(n * registers, np.inf)
    out = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(grams))
    round_ = 0
    while len(grams):
        round_ += 1
        chance = mix(grams + np.uint64(2 * round_ * 0x632BE59BD9B4E019 % 2**64))
        time = time - np.log(((chance >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights
        place = owner * registers + (mix(chance) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(came, place, time)
        won = came[place] == time
        out[place[won]] = grams[won]
        # a text's last register; what arrives later changes nothing
        latest = came.reshape(n, registers).max(1)
        go = time < latest[owner]
        grams, weights, owner, time = grams[go], weights[go], owner[go], time[go]
    return out.reshape(n, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Similarity of two weighted sets (sorted hashes, weights): the sum over common elements x of
    1 / sum over all elements y of max(a(y) / a(x), b(y) / b(x)). With equal weights it is the Jaccard similarity."""
    if a[1].max(initial=0) <= 1 and b[1].max(initial=0) <= 1:
        both = len(np.intersect1d(a[0], b[0], assume_unique=True))
        return both / max(1, len(a[0]) + len(b[0]) - both)
    every = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(every)), np.zeros(len(every))
    wa[np.searchsorted(every, a[0])] = a[1]
    wb[np.searchsorted(every, b[0])] = b[1]
    base = int(wb.max(initial=0)) + 1
    kinds, counts = np.unique((wa * base + wb).astype(np.int64), return_counts=True)
    kinds = np.column_stack([kinds // base, kinds % base])
    total = 0.0
    for (x, y), n in zip(kinds.tolist(), counts.tolist(), strict=True):
        if x and y:
            total += n / (counts * np.maximum(kinds[:, 0] / x, kinds[:, 1] / y)).sum()
    return total


def _sequence_hashes(words: Words) -> np.ndarray:
    """16 bytes for each text's sequence of words."""
    hashes = words.hashes()
    inner = np.arange(len(hashes)) - np.repeat(words.first[:-1], words.counts())
    out = np.zeros((len(words.first) - 1, 2), np.uint64)
    full = np.flatnonzero(words.counts() > 0)
    for k, base in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
        if len(full):
            factors = mix(np.uint64(base) * (inner.astype(np.uint64) + np.uint64(1))) | np.uint64(1)
            parts = mix(hashes ^ np.uint64(base)) * factors
            out[full, k] = mix(np.add.reduceat(parts, words.first[:-1][full]) + words.counts()[full].astype(np.uint64))
    return out


def signed(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, row, text): doc_id, row, node (16 bytes that stand for the words), bands (null without words), signature."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in steps(batches):
            words = Words(column(table, "text"))
            found = signatures(*shingles(words))
            nodes = _sequence_hashes(words)
            found &= np.uint64(0xFFFF)  # what the signature keeps, so that it tells the bands in which two nodes meet
            banded = found.reshape(len(found), -1, BAND)
            keys = np.zeros(banded.shape[:2], np.uint64)
            for i in range(BAND):
                keys = mix(keys + banded[:, :, i] + np.uint64(i + 1))
            keys = mix(keys + np.arange(keys.shape[1], dtype=np.uint64)).view(np.int64)
            empty = words.counts() == 0
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": column(table, "doc_id"),
                    "row": column(table, "row"),
                    "node": pa.array([x.tobytes() for x in nodes], pa.binary()),
                    "bands": pa.array([None if e else k for e, k in zip(empty.tolist(), keys, strict=True)], pa.list_(pa.int64())),
                    "signature": pa.array([x.tobytes() for x in found.astype("<u2")], pa.binary()),
                }
            )

    return docs.mapInArrow(sign, f"doc_id {kind}, row bigint, node binary, bands array<bigint>, signature binary")


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs(a, b) of nodes that agree in enough registers."""
    sides = [nodes.select(F.col("node").alias(x), F.col("signature").alias(f"{x}_signature")) for x in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_signature", "b_signature")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(f"{x}_signature").to_pylist()), "<u2").reshape(-1, REGISTERS) for x in "ab")
            keep = pa.array((a == b).sum(1) >= LEAST_AGREEING)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return met.mapInArrow(compare, "a binary, b binary")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs(a, b) whose texts have at least the similarity, on all their shingles. The text of b moves to a's partition."""
    near = _agreeing(pairs, nodes)
    carried = near.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    met = carried.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a").select("a", "b", "a_text", "b_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_coded = batch.column("a").dictionary_encode()
            code = a_coded.indices.to_numpy(zero_copy_only=False)
            one = np.unique(code, return_index=True)[1]
            sets = []
            for texts_ in (batch.column("a_text").take(pa.array(one)), batch.column("b_text")):
                grams, weights, first = shingles(Words(texts_))
                sets.append([(grams[x:y], weights[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
            order = {c: i for i, c in enumerate(code[one].tolist())}
            keep = pa.array([probability_jaccard(sets[0][order[c]], s) >= similarity - 1e-9 for c, s in zip(code.tolist(), sets[1], strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return met.mapInArrow(verify, "a binary, b binary")


def connected(edges: DataFrame) -> DataFrame:
    """Node and label, the least node of its component, for the nodes of edges(a, b). A round takes the least label among a node and its
    neighbours, then the label of that label, and is written; rounds end when no label changes."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        ups = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        new = cut(low.join(ups, "low", "left").select("node", "was", F.least("low", "up").alias("label")))
        labels = new.select("node", "label")
        if new.filter("label != was").isEmpty():
            return labels


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members(bucket, band, node) of buckets in which several components meet, with their label and the size of the bucket."""
    marked = members.join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("label", "node").alias("label"))
    mixed = marked.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).filter("low != high")
    return marked.join(mixed.select("bucket", "size"), "bucket")


def _stars(members: DataFrame) -> DataFrame:
    """Each node of members(bucket, node) beside the least node of its bucket, once."""
    least = members.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("high")).filter("a != high").drop("high")
    return members.join(least, "bucket").filter("a != node").select("a", F.col("node").alias("b")).distinct()


def _near_pairs(signature: np.ndarray, label: np.ndarray, own: np.ndarray, band: int) -> np.ndarray:
    """Pairs (i < j, registers that agree) of a block's nodes that are this block's to verify: of different labels, agreeing in enough
    registers, meeting in no earlier band, and from both sides where the block has two."""
    hits = []
    apart = own.min(initial=0) != own.max(initial=0)
    for i in range(0, len(label), 32):
        some = np.arange(i, min(i + 32, len(label)))
        agree = (signature[some][:, None, :] == signature[None, i:, :]).sum(2)
        differ = (label[some][:, None] != label[None, i:]) & (some[:, None] < np.arange(i, len(label))[None, :])
        if apart:
            differ &= own[some][:, None] != own[None, i:]
        x, y = np.nonzero((agree >= LEAST_AGREEING) & differ)
        first = (signature[some[x]] == signature[y + i]).reshape(len(x), REGISTERS // BAND, BAND).all(2).argmax(1)
        x, y = x[first == band], y[first == band]
        hits.append(np.column_stack([some[x], y + i, agree[x, y]]))
    return np.concatenate(hits) if hits else np.zeros((0, 3), np.int64)


def _matrix(signatures_: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures_.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _undecided(apart: DataFrame, nodes: DataFrame) -> DataFrame:
    """Block, band, node, label, own and signature of the nodes that have a pair to verify. Buckets are looked through block by block: a
    block's nodes with those of its own or of one other block, inside a task. A pair belongs to the first band in which it
    meets, and there to one block, so it is verified once."""
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = apart.join(nodes.select("node", "signature"), "node").withColumn("own", F.pmod(F.xxhash64("node"), count).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    keys = ["bucket", "band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    blocks = dealt.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("node", "label", "own", "signature"))).alias("rows"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, band, rows in zip(batch.column("block").to_pylist(), batch.column("band").to_pylist(), batch.column("rows"), strict=True):
                rows = rows.values
                label = rows.field("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)
                pairs = _near_pairs(_matrix(rows.field("signature")), label, rows.field("own").to_numpy(zero_copy_only=False), band)
                if len(pairs):
                    rows = rows.take(pa.array(np.unique(pairs[:, :2])))
                    fixed = [pa.array([block] * len(rows), pa.int64()), pa.array([band] * len(rows), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*fixed, *(rows.field(x) for x in ("node", "label", "own", "signature"))], ["block", "band", "node", "label", "own", "signature"])

    named = blocks.select(F.xxhash64("bucket", "low", "high").alias("block"), F.col("band").cast("int").alias("band"), "rows")
    return named.mapInArrow(find, "block bigint, band int, node binary, label binary, own int, signature binary")


def _products(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> dict[tuple[int, int], np.ndarray]:
    """For every two parts (owners, elements), each of distinct pairs, the number of elements that owner i has in the one and owner j in the
    other, for all i and j; some elements at a time."""
    out = {(u, v): np.zeros((n, n), np.float32) for u in range(len(parts)) for v in range(u, len(parts))}
    ordered = []
    for owner, element in parts:
        order = np.argsort(element, kind="stable")
        ordered.append((owner[order], element[order]))
    for low in range(0, max((int(e[-1]) + 1 for _, e in ordered if len(e)), default=0), 4096):
        held = []
        for owner, element in ordered:
            a, b = np.searchsorted(element, [low, low + 4096])
            part = np.zeros((n, 4096), np.float32)
            part[owner[a:b], element[a:b] - low] = 1
            held.append(part)
        for u, v in out:
            out[u, v] += held[u] @ held[v].T
    return out


#: Weights that are told apart for all pairs of a block at once; pairs with others are compared one by one.
WEIGHTS = 4


def _similar(sets: list[tuple[np.ndarray, np.ndarray]], pairs: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (i, j) of weighted sets have at least the similarity: 1 or 0, and 2 for pairs that `probability_jaccard` has to decide.

    With M, the weight that two sets share, and their total weights, the share s = M / the greater total bounds the similarity
    from below by s / (2 - s), and M / the smaller total from above, since it is a coupling of the two distributions that agrees
    no oftener than any can. Without weights M gives it exactly. What the bounds leave open is computed from the numbers of elements
    of each weight in either set, for all pairs at once where the weights are few."""
    i, j = pairs[:, 0], pairs[:, 1]
    sizes = np.array([len(g) for g, _ in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    weight = np.concatenate([w for _, w in sets]).astype(np.int64)
    element = np.unique(np.concatenate([g for g, _ in sets]), return_inverse=True)[1]
    total = np.bincount(owner, weight, len(sets))
    plain = np.array([w.max(initial=0) <= 1 for _, w in sets])

    # an element of weight w stands for w elements: its first, second, ... copy
    copy = spans(np.zeros(len(weight), np.int64), weight)
    copies = np.unique(np.repeat(element, weight) * (int(weight.max(initial=0)) + 1) + copy, return_inverse=True, return_counts=True)
    several = copies[2][copies[1]] > 1  # what one set alone has is in no common weight
    copied = np.repeat(owner, weight)[several], np.unique(copies[1][several], return_inverse=True)[1]
    common = _products([copied], len(sets))[0, 0][i, j].astype(np.float64)
    exact = common / np.maximum(1, total[i] + total[j] - common)
    share = common / np.maximum(1, np.maximum(total[i], total[j]))
    out = np.where(share / (2 - share) >= similarity, 1, np.where(common / np.maximum(1, np.minimum(total[i], total[j])) < similarity - 1e-9, 0, 2)).astype(np.int8)
    counted = plain[i] & plain[j]
    out[counted] = exact[counted] >= similarity - 1e-9

    left = np.flatnonzero(out == 2)
    if len(left):
        asked = np.zeros(len(sets), bool)
        asked[pairs[left, :2]] = True
        kinds, n = np.unique(weight[asked[owner]], return_counts=True)
        kinds = np.sort(kinds[np.argsort(-n)[:WEIGHTS]])
        odd = np.zeros(len(sets), bool)
        odd[owner[~np.isin(weight, kinds)]] = True
        left = left[~(odd[i[left]] | odd[j[left]])]
        out[left] = _weighted(owner, element, weight, kinds, len(sets), pairs[left, :2]) >= similarity - 1e-9
    return out


def _weighted(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, kinds: np.ndarray, n: int, pairs: np.ndarray) -> np.ndarray:
    """`probability_jaccard` of pairs of sets whose weights are among the kinds."""
    used, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(pairs.shape)
    here = np.full(n, -1)
    here[used] = np.arange(len(used))
    mine = here[owner] >= 0
    owner, element, weight = here[owner[mine]], element[mine], weight[mine]
    element = np.unique(element, return_inverse=True)[1]
    parts = [(owner[weight == k], element[weight == k]) for k in kinds]
    met = _products(parts, len(used))
    number = np.zeros((len(kinds) + 1, len(kinds) + 1, len(pairs)))  # elements of weight kinds[u - 1] in i and kinds[v - 1] in j; 0 is none
    for u in range(len(kinds)):
        for v in range(len(kinds)):
            number[u + 1, v + 1] = met[u, v][at[:, 0], at[:, 1]] if u <= v else met[v, u][at[:, 1], at[:, 0]]
        each = np.bincount(parts[u][0], minlength=len(used))
        number[u + 1, 0], number[0, u + 1] = each[at[:, 0]], each[at[:, 1]]
    number[1:, 0] -= number[1:, 1:].sum(1)
    number[0, 1:] -= number[1:, 1:].sum(0)
    values = np.concatenate([[0], kinds]).astype(float)
    found = np.zeros(len(pairs))
    for u, x in enumerate(kinds, 1):
        for v, y in enumerate(kinds, 1):
            ratio = np.maximum(values[:, None] / x, values[None, :] / y)
            found += number[u, v] / np.maximum(1e-300, np.tensordot(ratio, number, 2))
    return found


def _links(undecided: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Edges(a, b) that connect what is similar in each block, on all shingles; a pair that is connected already is left out, so
    that a block has at most as many edges as nodes."""
    met = undecided.join(texts, "node").repartition("block").sortWithinPartitions("block")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
                piece = batch.slice(part[0], len(part)) if len(part) else None
                if piece is not None and held and held[0].column("block")[0] != piece.column("block")[0]:
                    yield pa.Table.from_batches(held)
                    held = []
                if piece is not None:
                    held.append(piece)
        if held:
            yield pa.Table.from_batches(held)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            node = table["node"].to_pylist()
            label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            pairs = _near_pairs(_matrix(table["signature"]), label, column(table, "own").to_numpy(zero_copy_only=False), table["band"][0].as_py())
            if not len(pairs):
                continue
            grams, weights, first = shingles(Words(column(table, "text")))
            sets = [(grams[x:y], weights[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            group = label.copy()
            edges = []
            answer = _similar(sets, pairs, similarity)
            order = np.lexsort((-pairs[:, 2], answer))  # what is sure first, then the most alike
            for i, j, _, sure in np.column_stack([pairs, answer])[order[answer[order] > 0]].tolist():
                if group[i] != group[j] and (sure == 1 or probability_jaccard(sets[i], sets[j]) >= similarity - 1e-9):
                    group[group == group[j]] = group[i]
                    edges.append((min(node[i], node[j]), max(node[i], node[j])))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in edges], pa.binary()), "b": pa.array([b for _, b in edges], pa.binary())})

    return met.select("block", "band", "node", "label", "own", "signature", "text").mapInArrow(link, "a binary, b binary")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, row (a hash of the text), class_id, the least id among the documents of its class, and label,
    which tells classes apart.

    Texts of the same words are one node. Nodes whose probability Jaccard similarity over word shingles is at least
    `similarity` are linked, and a class is what links connect. Texts without words (null ones too) are one class. A null id
    counts as no id: a class of such rows alone has none. Repeated rows each get the result.

    The nodes of some bands' buckets are first compared with the bucket's least node, which joins dense groups of any size in one
    pass. Only buckets that this leaves in several components are looked at again: their nodes' signatures are compared with
    each other in blocks, and the pairs that agree enough are verified until all are connected or found to be apart. So no link
    that would connect different texts is lost but by the chances that BAND and LEAST_AGREEING state.
    Equal texts, labels and buckets are aggregated before they move. Tables written: signatures, the texts of nodes that share a
    bucket, and small steps.
    """
    small_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text").withColumn("row", F.xxhash64("text"))
    signed_ = cut(signed(docs))
    nodes = signed_.filter("bands is not null").groupBy("node").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.min(F.struct("doc_id", "row")).alias("doc"))
    nodes = cut(nodes)
    banded = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high").select("bucket")
    members = cut(banded.join(shared, "bucket").select("bucket", "band", "node"))
    needed = members.select("node").distinct().join(nodes, "node").select("node", "doc.doc_id", "doc.row").alias("n")
    d = docs.alias("d")
    found = d.join(needed, F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.row") == F.col("n.row"))).select("n.node", "d.text")
    texts = cut(found.groupBy("node").agg(F.first("text").alias("text")))

    tested = cut(_stars(members.filter(F.col("band") < FIRST_BANDS).select("bucket", "node")))
    edges = cut(verified(tested, nodes, texts, similarity))
    labels = connected(edges)
    apart = cut(_apart(members, labels))
    if not apart.isEmpty():
        edges = cut(edges.unionByName(_links(cut(_undecided(apart, nodes)), texts, similarity)).distinct())
        labels = connected(edges)

    placed = signed_.select("doc_id", "row", "node").join(labels, "node", "left").select("doc_id", "row", F.coalesce("label", "node").alias("label"))
    named = placed.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return placed.join(named, "label").select("doc_id", "row", "class_id", "label")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs(doc_id, text, ...), with all their columns, that stay: of each class the document with the least id
    (of several with that id, the one whose text has the least hash), of rows repeated in full one. Null ids come last."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(x)}") for x in ("doc_id", "text"))
    key = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("k_id"), F.isnull("doc_id").alias("k_null"), F.col("row").alias("k_row")]
    found = classes(docs, similarity).groupBy("label").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("stays"))
    stays = found.select("stays.doc_id", "stays.row").select(*key)
    keyed = plain.select("*", F.coalesce(doc_id, F.lit(0)).alias("k_id"), F.isnull(doc_id).alias("k_null"), F.xxhash64(text).alias("k_row"))
    once = keyed.join(stays, ["k_id", "k_null", "k_row"], "left_semi").dropDuplicates(["k_id", "k_null", "k_row"])
    return once.select(*plain.columns).toDF(*names)
