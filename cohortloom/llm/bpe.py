"""Byte-level BPE through a minimal acyclic transducer lexicon.

The corpus's frequent words are compiled, with the ids that BPE gives them, into a
minimal acyclic automaton: states with equal continuations are one state, and the
numbers on the arcs of a word's path add up to the row of its ids. The automaton is a
flat file that executors receive once and map into memory. Words it does not hold are
merged exactly by rank, so the lexicon affects speed and never the result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, share_file, store, texts_of
from .pieces import byte_level_pieces, once_per_worker, text_blocks

#: Words that the lexicon holds.
LEXICON = 300_000
#: Distinct pieces that a task counts before it passes the words of repeated ones on.
COUNTED = 250_000
#: Characters of text that are cut and looked up at a time.
BLOCK_CHARS = 1 << 23
#: Symbols up to which a word is merged by scanning, beyond it with a heap.
SCAN = 48
#: The pattern that byte-level BPE vocabularies of this kind are split by.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_alphabet() -> dict[str, int]:
    """Byte of each character in the printable form of byte-level vocabularies.

    Printable Latin-1 characters stand for their own byte; the other bytes, in order,
    have the characters from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        model = spec["model"]
        ids = model["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(map(alphabet.__getitem__, t)) for t, i in ids.items()}
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = ids[c]
        # Rank of each pair of ids, and the id that the pair of a rank becomes.
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault(ids[a] << 32 | ids[b], rank)
            self.merged.append(ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > SCAN:
            return self._merge_long(ids)
        get, merged, none = self.rank.get, self.merged, len(self.merged)
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = merged[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap over a linked list: n log n for words of any length."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.rank.get
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (found, i, ids[i] << 32 | ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return tuple(x for x in ids if x >= 0)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, special tokens included, as the bytes they stand for."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Transducer:
    """A minimal acyclic automaton over byte strings whose paths add up to a row number."""

    def __init__(self, blob: np.ndarray) -> None:
        head = blob[:40].view("<i8")
        self.root, arcs, states, rows, flat = (int(x) for x in head)
        at = 40
        take = lambda n, kind: blob[at : at + n * np.dtype(kind).itemsize].view(kind)
        self.arc_key = take(arcs, "<i8")
        at += arcs * 8
        self.arc_to = take(arcs, "<i4")
        at += arcs * 4
        self.arc_add = take(arcs, "<i4")
        at += arcs * 4
        self.row_end = take(rows, "<i4")
        at += rows * 4
        self.ids = take(flat, "<i4")
        at += flat * 4
        self.final = take(states, "u1")

    @classmethod
    def open(cls, path: str) -> Transducer:
        """Map a compiled file into memory."""
        return cls(np.memmap(path, dtype=np.uint8, mode="r"))

    @staticmethod
    def compile(entries: dict[bytes, tuple[int, ...]]) -> bytes:
        """The flat file of a lexicon: suffixes are shared as words arrive in order."""
        known: dict[tuple, int] = {}
        arcs: list[tuple[tuple[int, int], ...]] = []
        final: list[bool] = []

        def settle(node: list) -> int:
            """Number of the one state with this node's continuations."""
            key = (node[0], tuple(node[1]))
            state = known.get(key)
            if state is None:
                state = known[key] = len(arcs)
                arcs.append(key[1])
                final.append(node[0])
            return state

        # The path of the last word: nodes [is final, [(byte, state)...], byte that leads here].
        path: list[list] = [[False, [], -1]]
        words = sorted(entries)
        last = b""
        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            while len(path) > shared + 1:
                node = path.pop()
                path[-1][1].append((node[2], settle(node)))
            path += [[False, [], b] for b in word[shared:]]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((node[2], settle(node)))
        root = settle(path[0])
        below = [0] * len(arcs)
        flat_arcs: list[tuple[int, int, int]] = []
        for state, out in enumerate(arcs):  # children have smaller numbers
            n = int(final[state])
            for byte, to in out:
                flat_arcs.append((state << 8 | byte, to, n))
                n += below[to]
            below[state] = n
        keys = np.array([a[0] for a in flat_arcs], dtype="<i8")
        order = np.argsort(keys)
        ids = [entries[w] for w in words]
        head = np.array([root, len(flat_arcs), len(arcs), len(words), sum(map(len, ids))], dtype="<i8")
        return b"".join(
            x.tobytes()
            for x in (
                head, keys[order], np.array([a[1] for a in flat_arcs], dtype="<i4")[order], np.array([a[2] for a in flat_arcs], dtype="<i4")[order],
                np.cumsum([len(x) for x in ids]).astype("<i4"), np.array([i for x in ids for i in x], dtype="<i4"), np.array(final, dtype="u1"),
            )
        )

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Row of each word, -1 where the lexicon does not hold it; all words walk at once."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self.arc_key) or not words:
            return out
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.cumsum(size) - size
        live = np.arange(len(words))
        state, row = np.full(len(words), self.root, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        step = 0
        while len(live):
            done = size[live] == step
            ended = live[done & (self.final[state[live]] > 0)]
            out[ended] = row[ended]
            live = live[~done]
            if not len(live):
                break
            key = state[live] << 8 | data[begin[live] + step]
            arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            found = self.arc_key[arc] == key
            live, arc = live[found], arc[found]
            state[live] = self.arc_to[arc]
            row[live] += self.arc_add[arc]
            step += 1
        return out

    def ids_of(self, row: int) -> bytes:
        """Ids of a row, four bytes each."""
        return self.ids[(self.row_end[row - 1] if row else 0) : self.row_end[row]].tobytes()


def words_in(piece: str) -> list[bytes]:
    """The words of a piece that has its leading space, if any, as bytes."""
    return [w.encode("utf-8", "surrogatepass") for w in PATTERN.findall(piece)]


class Encoder:
    """Ids of texts by lexicon first and exact merges for the rest, as bytes, four for an id."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.special = {t: array("I", [i]).tobytes() for t, i in vocabulary.special.items()}

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of words: all walk through the automaton at once, what it lacks is merged."""
        ids_of, merge = self.lexicon.ids_of, self.vocabulary.merge
        return [ids_of(r) if r >= 0 else array("I", merge(w)).tobytes() for w, r in zip(words, self.lexicon.rows(words).tolist())]

    def piece_ids(self, heads: Iterable[str], tails: Iterable[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Ids of distinct pieces, those as they stand and those that lost their space."""
        first, later = dict.fromkeys(heads), dict.fromkeys(tails)
        # Most pieces are letters alone, and then they are one word.
        plain = [p for p in later if p.isalpha()]
        cut = [(later, p, words_in(" " + p)) for p in later if not p.isalpha()] + [(first, p, words_in(p)) for p in first]
        parts = list(dict.fromkeys(chain.from_iterable(ws for _, _, ws in cut)))
        found = self.word_ids([b" " + p.encode() for p in plain] + parts)
        later.update(zip(plain, found))
        whole = dict(zip(parts, found[len(plain) :]))
        for to, p, ws in cut:
            to[p] = whole[ws[0]] if len(ws) == 1 else b"".join(map(whole.__getitem__, ws))
        return first, later

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """(text, is special) in order: special tokens are cut out before anything else."""
        special = self.vocabulary.special_pattern
        if special is None or not any(t in text for t in self.vocabulary.special):
            return [(text, False)] if text else []
        return [(t, t in self.vocabulary.special) for t in special.split(text) if t]

    def encode_block(self, texts: list[str]) -> Iterator[list[bytes]]:
        """For each text the ids of its pieces in order; each distinct piece is looked up once."""
        # A special token stands without pieces; a later piece of a segment lost its space.
        cut = [[(t, None if s else byte_level_pieces(t)) for t, s in self.segments(text)] for text in texts]
        first, later = self.piece_ids((p[0] for parts in cut for _, p in parts if p), chain.from_iterable(islice(p, 1, None) for parts in cut for _, p in parts if p))
        for parts in cut:
            ids: list[bytes] = []
            for t, p in parts:
                if p is None:
                    ids.append(self.special[t])
                else:
                    ids.append(first[p[0]])
                    ids += map(later.__getitem__, islice(p, 1, None))
            yield ids

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return array("I", b"".join(next(self.encode_block([text])))).tolist()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (word binary, n): words of all texts and how often tasks met them.

    A task counts the pieces of its texts and passes on the words of those that occurred
    again before it had met COUNTED different ones: a frequent word is counted wherever
    it is, a rare one may be counted short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for text in texts_of(batch, "text"):
                held.update(islice(byte_level_pieces(text), 1, None))
                if len(held) >= COUNTED:
                    yield folded(held)
                    held = Counter()
        if held:
            yield folded(held)

    def folded(held: Counter[str]) -> pa.RecordBatch:
        words: Counter[bytes] = Counter()
        for piece, n in held.items():
            if n > 1:
                for word in [b" " + piece.encode()] if piece.isalpha() else words_in(" " + piece):
                    words[word] += n
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, most: int = LEXICON, text_col: str = "text") -> str:
    """Compile a lexicon, send its file to the executors, return the file's name.

    It holds the ``most`` most frequent words, counted over all texts. What it holds decides
    how fast words are encoded, never how.
    """
    vocabulary = Vocabulary(path)
    counts = store(word_counts(docs, text_col).where(F.length("word").between(1, 64)), "words")
    # Words of equal count are all in or all out, so at most ``most`` words are collected.
    # The distinct counts above the cut are fewer than ``most`` too.
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(most).collect()
    room, least = most, 1 << 62
    for row in sizes:
        if row.words > room:
            break
        room, least = room - row.words, row.n
    words = counts.where(F.col("n") >= least).select("word").toArrow().column("word").to_pylist()
    blob = Transducer.compile({w: vocabulary.merge(w) for w in words})
    release(counts)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    share_file(docs.sparkSession, blob, name)
    return name


def worker_encoder(path: str, lexicon: str) -> Encoder:
    """The worker's encoder: one vocabulary, one mapped lexicon, the last ones asked for."""
    vocabulary = once_per_worker("bpe vocabulary", (path,), lambda: Vocabulary(path))
    return once_per_worker("bpe encoder", (path, lexicon), lambda: Encoder(vocabulary, Transducer.open(SparkFiles.get(lexicon))))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one per row of ``docs``.

    Ids are those of the tokenizers library without added special tokens; strings of
    special tokens inside a text become their ids, as is its default. The ids are decoded
    again, special tokens included. A null or empty text has no ids and decodes to "".
    Repeated rows stay; null ids of documents stay null; an empty table gives no rows.
    """
    name = build_lexicon(docs, path, lexicon_words, text_col=text_col)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, name)
        vocabulary = encoder.vocabulary
        number, of_id = once_per_worker("bpe tables", (path,), lambda: ([str(i) for i in range(max(vocabulary.bytes_of) + 1)], [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of) + 1)]))
        for batch in batches:
            texts = texts_of(batch, "text")
            counts: list[int] = []
            ids_sha: list[str] = []
            decoded_sha: list[str] = []
            for a, b in text_blocks(texts, BLOCK_CHARS):
                for pieces in encoder.encode_block(texts[a:b]):
                    ids = array("I", b"".join(pieces)).tolist()
                    text = b"".join(map(of_id.__getitem__, ids)).decode("utf-8", "replace")
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<int>) with a lexicon of ``build_lexicon``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([encoder.encode(t) for t in texts_of(batch, "text")], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids); null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = once_per_worker("bpe vocabulary", (path,), lambda: Vocabulary(path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([vocabulary.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
