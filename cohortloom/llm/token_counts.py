"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts go to the encoder in batches balanced by bytes. A text longer than a batch is first
split at places where its tokenizer cuts in any case, so the lengths of its parts add up;
no ids leave the function.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spans_by_bytes, texts_of
from .pieces import once_per_worker

#: Bytes in one call of the encoder.
BATCH_BYTES = 1 << 18
#: Where a byte-level tokenizer with the usual pattern always cuts: before a single space
#: between characters that are not white space, between a letter and a digit, and between
#: a letter or digit and a mark (the mark may lead a contraction, so never after one).
_BYTE_LEVEL = re.compile(r"(?<=\S)(?= \S)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])")
#: Where a word-marking piece model cuts: at a single space between ASCII letters or digits.
_BETWEEN_WORDS = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def load_tokenizer(path: str):
    """A tokenizers.Tokenizer for .json, a SentencePieceProcessor for .model; one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_lengths(tokenizer, texts: list[str], batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Token counts of ``texts``, encoded in batches balanced by bytes."""
    out: list[int] = []
    for a, b in spans_by_bytes([utf8_length(t) for t in texts], batch_bytes):
        if hasattr(tokenizer, "encode_batch_fast"):
            out += [len(e) for e in tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]
        else:
            out += [len(ids) for ids in tokenizer.encode(texts[a:b], num_threads=1)]
    return out


def utf8_length(text: str) -> int:
    """Bytes of a text in UTF-8."""
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


class SafePlaces(NamedTuple):
    """Where texts may be split without changing their tokens: matches of a pattern that lie
    in none of the added tokens."""

    pattern: re.Pattern[str]
    added: tuple[str, ...] = ()

    def after(self, text: str, begin: int) -> tuple[int, int] | None:
        """End of one part and begin of the next, at the first place from ``begin`` on."""
        for m in self.pattern.finditer(text, begin):
            at = m.start()
            if not any(text.find(t, max(0, at - len(t) + 1), at + len(t) - 1) >= 0 for t in self.added):
                return at, m.end()
        return None


def safe_places(path: str) -> SafePlaces | None:
    """The safe places of a tokenizer, None where none are known.

    Known are byte-level tokenizers with the usual pattern and no normalizer, and piece
    models in which the word mark only leads.
    """
    if path.endswith(".model"):
        model = load_tokenizer(path)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        leads = not any("\u2581" in p.lstrip("\u2581") for p in pieces)
        return SafePlaces(_BETWEEN_WORDS) if leads and model.encode("a b") == model.encode("a") + model.encode("b") else None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    usual = (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and bool(pre.get("use_regex"))
        and not pre.get("add_prefix_space")
        and spec["model"].get("type") == "BPE"
    )
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    return SafePlaces(_BYTE_LEVEL, tuple(t["content"] for t in spec["added_tokens"])) if usual and plain else None


def parts_of(text: str, places: SafePlaces | None, most: int = BATCH_BYTES) -> list[str]:
    """A text in parts of at most ``most`` characters or so, cut at safe places.

    A part grows beyond that only up to the next safe place. Where a place is a space that
    the pattern consumes, it goes with neither part.
    """
    if places is None or len(text) <= most:
        return [text]
    out, begin = [], 0
    while len(text) - begin > most:
        place = places.after(text, begin + most)
        if place is None:
            break
        out.append(text[begin : place[0]])
        begin = place[1]
    return [*out, text[begin:]]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per row of ``docs``; no shuffle.

    Counts are those of the library for the whole text, without begin, end or other added
    special tokens; strings of special tokens inside a text are handled as its default. A
    null or empty text has 0 bytes and 0 tokens. Repeated rows stay; null ids stay null; an
    empty table gives no rows. Tokenizers without known safe places get long texts whole.
    """
    places = safe_places(path)
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = once_per_worker("tokenizer", (path,), lambda: load_tokenizer(path))
        for batch in batches:
            texts = texts_of(batch, "text")
            parts = [parts_of(t, places) for t in texts]
            lengths = iter(encode_lengths(tokenizer, [p for ps in parts for p in ps]))
            n_tokens = [sum(next(lengths) for _ in ps) for ps in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([utf8_length(t) for t in texts], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                schema=out,
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
