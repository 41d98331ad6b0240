"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Words are merged together: their symbols lie in flat arrays. A round finds the best pair of every word (segmented
minimum of the pair ranks), merges it wherever it occurs from the left, and closes the gaps; a word leaves when it has no
pair left. Equal words are merged once a task and kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from heddle.llm.common import column, pick, small_batches, spans, steps

NO_PAIR = np.int32(2**31 - 1)
SPACE = "▁"
#: Spellings whose ids a worker keeps; beyond that it starts anew.
KEPT_WORDS = 200_000


class Model:
    """Tables of a SentencePiece BPE model: pair ranks, ids of characters and bytes, and what each id decodes to."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        with open(path, "rb") as file:
            raw = file.read()
        spec = sentencepiece_model_pb2.ModelProto.FromString(raw)
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only models that leave the text as it is, with a blank put before it, are supported")
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback are supported")
        library = SentencePieceProcessor(model_proto=raw)
        self.begin, self.end = library.bos_id(), library.eos_id()
        self.size = len(spec.pieces)
        kinds = [p.type for p in spec.pieces]
        if 4 in kinds or 5 in kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        if any(SPACE in piece.lstrip(SPACE) for piece in normal):
            raise ValueError("pieces that span words are not supported")
        self.char = {piece: i for piece, i in normal.items() if len(piece) == 1}
        if any(c not in self.char for piece in normal for c in piece):
            raise ValueError("a piece has a character that is no piece")
        self.byte_id = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        scores = np.array([p.score for p in spec.pieces], np.float32)
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs = {}
        for piece, i in normal.items():
            for at in range(1, len(piece)):
                left, right = normal.get(piece[:at]), normal.get(piece[at:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = i
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.merged = np.array([pairs[k] for k in keys.tolist()] + [0], np.int32)
        self.rank = np.append(rank[self.merged[:-1]], NO_PAIR)
        self._decoding(spec, kinds)

    def _decoding(self, spec, kinds: list[int]) -> None:
        out = []
        for p, kind in zip(spec.pieces, kinds, strict=True):
            if kind == 6:
                out.append(bytes([int(p.piece[3:5], 16)]))
            elif kind == 1:
                out.append(p.piece.replace(SPACE, " ").encode())
            else:
                out.append(spec.trainer_spec.unk_surface.encode() if kind == 2 else b"")
        self.surface = np.frombuffer(b"".join(out), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place in the pair table; the last place where there is no such pair."""
        key = left.astype(np.int64) * self.size + right
        key[(left >= self.size) | (right >= self.size)] = -1  # characters outside the vocabulary pair with nothing
        at = np.searchsorted(self.keys, key)
        at[self.keys[at] != key] = len(self.keys) - 1
        return at

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and where each word's begin (one more for the end)."""
        chars = "".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        spelled, back = np.unique(points, return_inverse=True)
        ids = np.array([self.char.get(chr(c), self.size + int(c)) for c in spelled.tolist()], np.int64)
        symbol, word = merge_rounds(self, ids[back], np.repeat(np.arange(len(words)), lengths))
        return self._with_bytes(symbol, word, len(words))

    def _with_bytes(self, symbol: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        unknown = np.flatnonzero(symbol >= self.size)
        size = np.ones(len(symbol), np.int64)
        encoded = [chr(int(symbol[i]) - self.size).encode("utf-8", "surrogatepass") for i in unknown]
        size[unknown] = [len(x) for x in encoded]
        at = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(at[-1], np.uint32)
        known = np.flatnonzero(symbol < self.size)
        out[at[known]] = symbol[known]
        if len(unknown):
            out[spans(at[unknown], size[unknown])] = self.byte_id[np.frombuffer(b"".join(encoded), np.uint8)]
        first = at[np.searchsorted(word, np.arange(n + 1))]
        return out, first

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of runs of ids: pieces put together, byte pieces read as UTF-8 (what is no UTF-8 becomes the
        replacement character), the blank that encoding puts first taken away. Control ids give nothing."""
        size = np.diff(self.surface_at)[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        raw = self.surface[spans(self.surface_at[ids], size)].tobytes()
        out = []
        for a, b in zip(at[first[:-1]].tolist(), at[first[1:]].tolist(), strict=True):
            text = raw[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


def merge_rounds(model: Model, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of each word until no pair remains; symbols and their words, in the order given.

    A round merges, in each word, the occurrences of its best rank from the left, without overlap. It stops in a
    word behind the first merge that makes a pair at least as good, because that pair comes next there.
    """
    done_symbol, done_word = [], []
    last = len(model.keys) - 1
    pair = np.full(len(symbol), last, np.int64)
    if len(symbol) > 1:
        inner = word[:-1] == word[1:]
        pair[:-1][inner] = model.look_up(symbol[:-1][inner], symbol[1:][inner])
    while len(symbol):
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        length = np.diff(np.append(begin, len(word)))
        rank = model.rank[pair]
        best = np.minimum.reduceat(rank, begin)
        live = best != NO_PAIR
        if not live.all():
            stay = np.repeat(live, length)
            done_symbol.append(symbol[~stay])
            done_word.append(word[~stay])
            symbol, word, pair, rank = symbol[stay], word[stay], pair[stay], rank[stay]
            best, length = best[live], length[live]
            if not len(symbol):
                break
        best = np.repeat(best, length)
        at = np.flatnonzero(rank == best)
        run = np.concatenate([[True], np.diff(at) != 1])  # neighbours overlap: every second of a run counts
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
        new = model.merged[pair[at]].astype(np.int64)
        # Pairs that the merge makes: with what stands left (itself perhaps merged) and right (as it is when merged).
        left_at = at - 1
        left_is = symbol[left_at]
        joined = np.concatenate([[False], at[:-1] + 2 == at[1:]])
        left_is = np.where(joined, np.concatenate([[0], new[:-1]]), left_is)
        has_left = (at > 0) & (word[left_at] == word[at])
        right_at = np.minimum(at + 2, len(symbol) - 1)
        has_right = (at + 2 < len(symbol)) & (word[right_at] == word[at])
        left_pair, right_pair = np.full(len(at), last), np.full(len(at), last)
        left_pair[has_left] = model.look_up(left_is[has_left], new[has_left])
        right_pair[has_right] = model.look_up(new[has_right], symbol[right_at[has_right]])
        better = np.minimum(model.rank[left_pair], model.rank[right_pair]) <= best[at]
        # Behind the first merge of a word that makes a better pair, the others wait for the next round.
        owner = word[at]
        group = np.concatenate([[True], owner[1:] != owner[:-1]])
        stops = np.cumsum(better) - better
        since = stops - np.maximum.accumulate(np.where(group, stops, 0))
        go = since == 0
        at, new, left_pair, right_pair = at[go], new[go], left_pair[go], right_pair[go]
        has_left, has_right = has_left[go], has_right[go]
        symbol[at] = new
        pair[at] = right_pair
        pair[at[has_left] - 1] = left_pair[has_left]
        # Two merges side by side: the pair between them is that of the two new symbols.
        close = np.flatnonzero(at[:-1] + 2 == at[1:])
        close = close[word[at[close]] == word[at[close + 1]]]
        pair[at[close]] = left_pair[close + 1]
        stay = np.ones(len(symbol), bool)
        stay[at + 1] = False
        symbol, word, pair = symbol[stay], word[stay], pair[stay]
    symbol = np.concatenate(done_symbol) if done_symbol else np.zeros(0, np.int64)
    word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
    order = np.argsort(word, kind="stable")
    return symbol[order], word[order]


@cache
def model_at(path: str) -> Model:
    return Model(path)


class Encoder:
    """Encodes runs of texts, keeping the ids of spellings it has met."""

    def __init__(self, model: Model, kept_words: int = KEPT_WORDS) -> None:
        self.model, self.kept_words = model, kept_words
        self.kept: dict[str, np.ndarray] = {}

    def _ids(self, words: list[str]) -> list[np.ndarray]:
        fresh = list(dict.fromkeys(w for w in words if w not in self.kept))
        if len(self.kept) + len(fresh) > self.kept_words:
            self.kept = {}
            fresh = list(dict.fromkeys(words))
        if fresh:
            ids, first = self.model.encode_words(fresh)
            first = first.tolist()
            for word, a, b in zip(fresh, first[:-1], first[1:], strict=True):
                self.kept[word] = ids[a:b].copy()
        return [self.kept[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end with begin and end ids, and where each text's begin."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = _odd(texts).to_numpy(zero_copy_only=False)
        if odd.any() and not odd.all():
            return _interleave(odd, self.encode(texts.filter(pa.array(odd))), self.encode(texts.filter(pa.array(~odd))))
        words = _split_oddly(texts) if odd.any() else _split(texts)
        spelled = words.code.dictionary
        found = self._ids(spelled.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate([*found, np.zeros(0, np.uint32)])
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        code = words.code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = sizes[code]
        body_at = np.concatenate([[0], np.cumsum(n)])
        body = flat[spans(starts[code], n)]
        lengths = body_at[words.first[1:]] - body_at[words.first[:-1]]
        first = np.concatenate([[0], np.cumsum(lengths + 2)]).astype(np.int64)
        out = np.empty(first[-1], np.uint32)
        out[first[:-1]] = self.model.begin
        out[first[1:] - 1] = self.model.end
        out[spans(first[:-1] + 1, lengths)] = body
        return out, first


class _Split:
    def __init__(self, code: pa.DictionaryArray, first: np.ndarray) -> None:
        self.code, self.first = code, first


def _interleave(mask: np.ndarray, yes: tuple, no: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `yes` where the mask is set and of `no` elsewhere, in the mask's order."""
    begin, size = np.zeros(len(mask), np.int64), np.zeros(len(mask), np.int64)
    for chosen, (_, first), shift in ((mask, yes, 0), (~mask, no, len(yes[0]))):
        begin[chosen], size[chosen] = first[:-1] + shift, np.diff(first)
    return np.concatenate([yes[0], no[0]])[spans(begin, size)], np.concatenate([[0], np.cumsum(size)])


def _odd(texts: pa.Array) -> pa.Array:
    """Texts in which blanks may stand side by side, as the model sees them."""
    return pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, SPACE))


def _split(texts: pa.Array) -> _Split:
    """Each text cut before every blank; blanks are written as the model writes them."""
    split = pc.split_pattern(texts, " ")
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
    flat = split.flatten()
    if empty.any():
        flat = flat.filter(pa.array(np.repeat(~empty, counts)))
        counts[empty] = 0
    coded = flat.dictionary_encode()
    marked = pc.binary_join_element_wise(pa.scalar("", flat.type), coded.dictionary, pa.scalar(SPACE, flat.type))
    return _Split(pa.DictionaryArray.from_arrays(coded.indices, marked), np.concatenate([[0], np.cumsum(counts)]))


def _split_oddly(texts: pa.Array) -> _Split:
    """The same where blanks run together: a word is a run of blanks with what follows it."""
    words: list[str] = []
    first = [0]
    for text in texts.to_pylist():
        if text:
            words += re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
        first.append(len(words))
    return _Split(pa.array(words, pa.large_string()).dictionary_encode(), np.array(first, np.int64))


@cache
def encoder_at(path: str) -> Encoder:
    return Encoder(model_at(path))


def encode_texts(docs: DataFrame, model_path: str, with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text): n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256
    (of the text that the ids decode to), with `with_ids` the ids and with `with_decoded` the decoded text themselves.

    A null text is an empty one: begin and end id. Every row is encoded whole; repeated rows each get theirs. Rows with
    null ids keep them. An empty table gives no rows. There is no shuffle: a lost executor's partitions are encoded again.
    """
    rows = pick(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    extra = (", ids array<int>" if with_ids else "") + (", decoded string" if with_decoded else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        encoder = encoder_at(model_path)
        for table in steps(batches):
            ids, first = encoder.encode(column(table, "text"))
            texts = encoder.model.decode(ids, first)
            raw = memoryview(ids.astype("<u4")).cast("B")
            ends = (first * 4).tolist()
            out = {
                "doc_id": column(table, "doc_id"),
                "n_tokens": pa.array(np.diff(first)),
                "ids_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)],
                "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
            if with_decoded:
                out["decoded"] = texts
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(encode, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")
