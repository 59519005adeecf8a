"""Sequence packing as vector bin packing with the dot-product heuristic.

Every example is cut into pieces of at most the sequence length; a piece has a demand in
three dimensions: tokens, segments and loss-bearing tokens. A bin is filled by placing,
again and again, the fitting class of pieces with the largest weighted dot product
between its demand and what is left in the bin. Pieces with equal demands form a class,
so a step costs one pass over the classes, of which there are a few thousand however many
pieces there are. Packing moves only metadata: ids stay where they were made.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, texts_of
from .pieces import PieceCache, once_per_worker, text_blocks
from .token_counts import load_tokenizer

#: Pieces that are packed together; more pieces make more groups, each packed apart.
GROUP = 60_000
#: Texts that a task has as Python strings at a time.
TEXTS = 512
#: Characters of text whose words are looked up at a time.
BLOCK_CHARS = 1 << 20
#: Separators that Python's split takes for white space and the tokenizer does not.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile("[\t-\r ]+")
#: Letters before ASCII marks: the split finds the letters, then the marks.
_MARKED = re.compile(r"[^\W\d_]+[!-/:-@\[-`{-~]+")


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


def vector_bin_pack(demand: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin of each item (rows of ``demand``), by dot products.

    Items must fit an empty bin. Ties go to the class with the larger first demand. The
    result depends only on the order of equal items, never on anything random.
    """
    classes, of_item, count = np.unique(demand, axis=0, return_inverse=True, return_counts=True)
    if (classes > capacity).any():
        raise ValueError("an item does not fit an empty bin")
    of_item = of_item.reshape(-1)
    queue = np.argsort(of_item, kind="stable")
    taken = np.concatenate([[0], np.cumsum(count)[:-1]])
    left = count.copy()
    # Demands as shares of the capacity, dimensions weighted by how scarce they are in all.
    share = classes / capacity
    weight = (share * count[:, None]).sum(axis=0)
    weight /= max(weight.sum(), 1e-12)
    bin_of, place = np.zeros(len(demand), dtype=np.int64), np.zeros(len(demand), dtype=np.int64)
    bins = 0
    live = np.arange(len(classes))
    while len(live):
        # Classes in order of their first demand: what still fits is among the first of them.
        own, own_share, stock = classes[live], share[live], left[live]
        first, rest = own[:, 0], own[:, 1:]
        room, n, most = capacity.astype(np.int64), 0, len(live)
        while True:
            most = int(np.searchsorted(first[:most], room[0], side="right"))
            fits = (stock[:most] > 0) & (rest[:most] <= room[1:]).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, own_share[:most] @ (weight * room / capacity), -1.0)
            at = most - 1 - int(np.argmax(score[::-1]))
            best = live[at]
            item = queue[taken[best]]
            taken[best] += 1
            left[best] -= 1
            stock[at] -= 1
            bin_of[item], place[item] = bins, n
            room = room - own[at]
            n += 1
        bins += 1
        if not stock.all():
            live = live[stock > 0]
    return bin_of, place


class WordRules(NamedTuple):
    """How a tokenizer reads words: drops white space, so that they can be encoded apart;
    reads them in lower case; and the first characters of its added tokens."""

    apart: bool
    lower: bool
    marks: str


def word_rules(path: str) -> WordRules:
    """The rules of a tokenizer file; for files of another kind texts are encoded whole.

    Words can be encoded apart where the normalizers are known, the split keeps only what is
    not white space, and no added token holds any.
    """
    if not path.endswith(".json"):
        return WordRules(False, False, "")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    listed = lambda node, many: (node or {}).get(many, [node] if node else [])
    normal, pre = listed(spec.get("normalizer"), "normalizers"), listed(spec.get("pre_tokenizer"), "pretokenizers")
    split = pre[0] if pre else {}
    regex_of = split.get("pattern", {}).get("Regex", "")
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and bool(split.get("invert")) and "\\s" not in regex_of.replace("[^\\s", "")
    added = spec["added_tokens"]
    plain = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    known = {"NFC", "Replace", "Lowercase"}
    apart = drops and plain and all(n["type"] in known and (n["type"] != "Replace" or n["content"] == " ") for n in normal)
    return WordRules(apart, any(n["type"] == "Lowercase" for n in normal), "".join(sorted({t["content"][0] for t in added})))


def words_of(text: str, rules: WordRules) -> list[str]:
    """Words between white space; ASCII texts in lower case where the tokenizer reads them
    so (unless that could spell an added token). Whole texts where words do not stand apart."""
    if not rules.apart:
        return [text]
    if any(c in text for c in _NOT_SPACE):
        return _SPACE.split(text)
    if rules.lower and text.isascii() and not any(m in text for m in rules.marks):
        text = text.lower()
    return text.split()


def word_ids(tokenizer):
    """A function from words to their ids as bytes, four each.

    Where the vocabulary marks the ends of what its split finds, words of plain Latin letters,
    alone or before ASCII marks, are encoded as one text of words and told apart by these
    ends; all others one by one.
    """
    if not hasattr(tokenizer, "encode_batch_fast"):
        return lambda words: [array("I", ids).tobytes() for ids in tokenizer.encode(words, num_threads=1)]

    def alone(words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
    ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def together(words: list[str], parts: int) -> list[bytes]:
        """Ids of words that the split finds in ``parts`` parts each."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = 4 * (np.flatnonzero(ends[ids]) + 1)
        if len(stops) != parts * len(words):
            return alone(words)
        data, begin, found = ids.tobytes(), 0, []
        for stop in stops[parts - 1 :: parts].tolist():
            found.append(data[begin:stop])
            begin = stop
        return found

    def ids_of(words: list[str]) -> list[bytes]:
        plain, marked, others = [], [], []
        for w in words:
            if not (w.isascii() or max(w) < "\u0130"):
                others.append(w)
            elif w.isalpha():
                plain.append(w)
            else:
                (marked if _MARKED.fullmatch(w) else others).append(w)
        of = dict(zip(plain, together(plain, 1)))
        of.update(zip(marked, together(marked, 2)))
        of.update(zip(others, alone(others)))
        return [of[w] for w in words]

    return ids_of


def encoded_blocks(texts: list[str], rules: WordRules, ids_of: PieceCache) -> Iterator[list[bytes]]:
    """For each text the ids of its words in order; a block's distinct words are encoded in one call."""
    for a, b in text_blocks(texts, BLOCK_CHARS):
        words = [words_of(t, rules) for t in texts[a:b]]
        found = ids_of.values(chain.from_iterable(words))
        for ws in words:
            yield list(map(found.__getitem__, ws))


def token_pieces(docs: DataFrame, path: str, end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens): texts encoded, ``end_id`` added, cut.

    A null or empty text is the one id ``end_id``. No shuffle; ids do not leave the function.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    end = np.array([end_id], dtype="<u4").tobytes()
    rules = word_rules(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = once_per_worker("word ids", (path,), lambda: PieceCache(word_ids(load_tokenizer(path))))
        step = 4 * length
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            rows: list[tuple] = []
            for doc_id, found in zip(batch.column(0).to_pylist(), encoded_blocks(texts_of(batch, "text"), rules, ids_of)):
                data = b"".join(found) + end
                rows += [(doc_id, i // 4, len(data[i : i + step]) // 4, zlib.crc32(data[i : i + step]), len(data) // 4) for i in range(0, len(data), step)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pack(pieces: DataFrame, limits: Limits = Limits(), group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows (doc_id, start, length, loss_tokens, ...).

    All pieces are dealt evenly, by the hash of their identity, to groups of about ``group``
    pieces, and each group is packed apart: a group's rows are a few numbers a piece. sequence_id is unique over all groups; offset counts the tokens
    before the piece in its sequence, without gaps. An empty table gives no rows.
    """
    groups = max(1, -(-pieces.count() // group))
    capacity = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.int64)
    schema = pieces.drop("loss_tokens").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
    columns = [c for c in pieces.columns if c != "loss_tokens"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start"], kind="stable", ignore_index=True)
        demand = np.stack([rows["length"].to_numpy(), np.ones(len(rows), dtype=np.int64), rows["loss_tokens"].to_numpy()], axis=1)
        bin_of, place = vector_bin_pack(demand.astype(np.int64), capacity)
        order = np.lexsort((place, bin_of))
        rows = rows.iloc[order]
        size, own = rows["length"].to_numpy(), bin_of[order]
        before = np.cumsum(size) - size
        first = np.concatenate([[True], own[1:] != own[:-1]])
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        return rows[columns].assign(sequence_id=(np.int64(key[0]) << 32) + own, offset=offset)

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(lambda key, rows: run(key, rows), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece.

    In plain documents every token but a segment's first bears loss. A null or empty text
    packs its end id alone; rows with equal or null ids are packed one by one; an empty
    table gives no rows.
    """
    longest = min(limits.tokens, limits.loss_tokens + 1)
    pieces = store(token_pieces(docs, path, end_id, longest, id_col, text_col), "pieces")
    return pack(pieces.withColumn("loss_tokens", F.col("length") - 1), limits)


def conversation_pieces(turns: DataFrame, path: str, limits: Limits, end_id: int = 2) -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, loss_tokens): conversations cut to fit a sequence.

    Loss is counted turn by turn: the tokens of assistant turns bear it, all others none. A
    piece ends before it would pass the token limit or the loss limit, so none is too large.
    Turns without a conversation are left to the conversation null; null texts are empty.
    """
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.octet_length(F.coalesce(F.col("text"), F.lit(""))))
    sized = store(token_pieces(turns.select(key.alias("doc_id"), "text"), path, end_id, 1 << 30).select("doc_id", F.col("doc_tokens").alias("n")).distinct(), "turns")
    each = turns.select(F.col("conv_id").cast("long").alias("doc_id"), "turn", (F.lower(F.coalesce("role", F.lit(""))) == "assistant").alias("bears"), key.alias("key"))
    each = each.join(sized.withColumnRenamed("doc_id", "key"), "key").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("turn", "key", "n", "bears"))).alias("runs"))
    names = ["doc_id", "start", "length", "doc_tokens", "loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = sum(r["n"] for r in runs)
                rows += [(doc_id, start, n, total, loss) for start, n, loss in cut_runs([(r["n"], r["bears"]) for r in runs], limits)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=names)

    return each.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def cut_runs(runs: list[tuple[int, bool]], limits: Limits) -> Iterator[tuple[int, int, int]]:
    """(start, length, loss) of pieces of runs (tokens, bears loss), each within the limits."""
    start = length = loss = 0
    for n, bears in runs:
        while n:
            room = limits.tokens - length
            if bears:
                room = min(room, limits.loss_tokens - loss)
            if not room:
                yield start, length, loss
                start, length, loss = start + length, 0, 0
                continue
            step = min(n, room)
            n, length, loss = n - step, length + step, loss + step * bears
    if length:
        yield start, length, loss


def pack_conversations(turns: DataFrame, path: str, limits: Limits = Limits(segments=16, loss_tokens=2048), end_id: int = 2) -> DataFrame:
    """Pack conversations (conv_id, turn, role, text): only assistant turns bear loss.

    Each turn is encoded apart and ended by ``end_id``; one conversation is one example,
    its turns in order, and is cut only where it passes a limit. All three limits bind here:
    half of a sequence may bear loss. Rows (doc_id, start, length, doc_tokens, sequence_id,
    offset); repeated turns count as often as they occur; an empty table gives no rows.
    """
    return pack(store(conversation_pieces(turns, path, limits, end_id), "conversations"), limits)
