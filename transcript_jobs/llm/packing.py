"""Order-preserving packing: cuts chosen by dynamic programming over document and sentence ends.

The stream of an input split is packed where it is read: documents stay in order, no text is shuffled, and a
task that is lost is packed again from its split with the same result.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_jobs.llm.common import table, text_or_empty

LENGTH = 1024
END = 0
END_BYTES = END.to_bytes(4, "little")
# Fixed value: how byte-level BPE parts a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of padding that a cut at a line end, a sentence end, or within a sentence is worth.
LINE_CUT, SENTENCE_CUT, HARD_CUT = 1, 2, 12
#: A sentence of more tokens than HARD_FROM may also be cut within, at every HARD_STEP tokens.
HARD_FROM, HARD_STEP = 32, 8
#: Tokens that are packed together; the last sequence of a block is carried into the next.
BLOCK = 1 << 19
#: Word pieces whose ids a worker keeps.
KEPT_WORDS = 300_000
#: White space other than space and line feed, in ASCII and in all.
_ALL_WHITE = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
_ASCII_WHITE = [c for c in _ALL_WHITE if c.isascii()]
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


def _lone_spaces(text: str) -> bool:
    """Whether no space of the text has other white space beside it, as far as quick looks tell."""
    odd = _ASCII_WHITE if text.isascii() else _ALL_WHITE
    return not ("  " in text or " \n" in text or "\n " in text or any(c in text for c in odd))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The ranks of a byte-level BPE whose ids follow its merges, else None: the two libraries then agree on every text."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    order = [model["vocab"][m.replace(" ", "")] for m in merges]
    if order != sorted(order) or order[0] != 256:
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


class Ids:
    """Token ids of whole texts, with the ids of frequent word pieces kept.

    The byte-level vocabulary never joins a space between two words to what stands before it, so a text is the sum
    of its pieces at such spaces; a space with white space of any kind beside it parts nothing. Pieces that are
    not kept yet are encoded by tiktoken where its ids must be the same (see _ranks), which takes a fifth of the
    time. Texts with a special token in them, and all texts of other vocabularies, are encoded whole by the
    tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = _ranks(spec)
        quick = ranks and tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.quick = quick and quick.encode_ordinary
        self.kept: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        texts = self.tok.decode_batch([[i] for i in range(self.tok.get_vocab_size())], skip_special_tokens=False)
        self.line = np.array([t.endswith("\n") for t in texts])
        self.sentence = np.array([t.rstrip("\"')]").endswith((".", "!", "?")) for t in texts])
        self.opens = np.array([t[:1].isspace() for t in texts])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, each ended by END."""
        first, rest = self.kept
        if len(first) + len(rest) > KEPT_WORDS:
            first.clear(), rest.clear()
        out = []
        for t in texts:
            if not self.quick or any(s in t for s in self.special):
                wire = _wire(self.tok.encode(t, add_special_tokens=False).ids)
            else:
                head, *words = t.split(" ") if _lone_spaces(t) else _BETWEEN_WORDS.split(t)
                try:
                    wire = first[head] + b"".join(map(rest.__getitem__, words))
                except KeyError:
                    if head not in first:
                        first[head] = _wire(self.quick(head))
                    for w in words:
                        if w not in rest:
                            rest[w] = _wire(self.quick(" " + w))
                    wire = first[head] + b"".join(map(rest.__getitem__, words))
            out.append(np.frombuffer(wire + END_BYTES, np.uint32))
        return out


def _wire(ids: list[int]) -> bytes:
    """Ids as unsigned little-endian 32-bit numbers."""
    return array("I", ids).tobytes()


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One encoder per worker process."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, enc: Ids, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places in the stream where a sequence may end, and what a cut there costs. ``doc_ends`` are places, the last is the end.

    No two that follow each other are more than ``length`` apart.
    """
    cost = np.full(len(ids) + 1, -1, np.int64)
    after = np.append(enc.opens[ids[1:]], True)
    cost[1:][enc.sentence[ids] & after] = SENTENCE_CUT
    cost[1:][enc.line[ids]] = LINE_CUT
    cost[0] = 0
    cost[doc_ends] = 0
    at = np.flatnonzero(cost >= 0)
    gaps = np.diff(at)
    step = min(HARD_STEP, length)
    long = np.flatnonzero(gaps > min(HARD_FROM, length))
    if len(long):
        hard = np.concatenate([np.arange(at[i] + step, at[i + 1], step) for i in long])
        cost[hard] = HARD_CUT
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cuts, as places, that make padding plus cut costs least; from at[0] to at[-1].

    f(j) = cost(j) + min over i with at(j) - at(i) <= length of f(i) + length - (at(j) - at(i)). As f(i) + at(i)
    does not depend on j, a queue of rising f(i) + at(i) gives every minimum in one pass.
    """
    pos, pen = at.tolist(), cost.tolist()
    came = [0] * len(pos)
    queue: deque[tuple[int, int]] = deque([(pos[0], 0)])
    for j in range(1, len(pos)):
        p = pos[j]
        floor = p - length
        while pos[queue[0][1]] < floor:
            queue.popleft()
        least, came[j] = queue[0]
        value = least + length + pen[j]  # f(j) + at(j)
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out, j = [pos[-1]], len(pos) - 1
    while j:
        j = came[j]
        out.append(pos[j])
    return out[::-1]


def pack_stream(batches: Iterator[tuple[list, list[str]]], enc: Ids, length: int = LENGTH, block: int = BLOCK) -> Iterator[dict]:
    """Columns of the pieces of one ordered stream of (keys, texts); sequences are numbered from 0."""
    keys: list = []
    starts: list[int] = []  # of the part in hand, in its document
    parts: list[np.ndarray] = []
    totals: list[int] = []
    held, sequence = 0, 0

    def packed(last: bool) -> Iterator[dict]:
        nonlocal keys, starts, parts, totals, held, sequence
        if not parts:
            return
        ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        cuts = best_cuts(*candidates(ids, ends, enc, length), length)
        stop = cuts[-1] if last or len(cuts) < 3 else cuts[-2]
        cuts = np.array([c for c in cuts if c <= stop])
        edges = np.unique(np.concatenate([cuts, ends[ends < stop], [0]]))
        a, b = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, a, side="right")
        seq = np.searchsorted(cuts, a, side="right") - 1
        begin = np.append(0, ends[:-1])
        yield {
            "key": [keys[d] for d in doc],
            "start": np.array(starts)[doc] + a - begin[doc],
            "length": b - a,
            "ids_crc32": [zlib.crc32(ids[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)],
            "doc_tokens": np.array(totals)[doc],
            "sequence": sequence + seq,
            "offset": a - cuts[seq],
            "ids": [ids[x:y].view(np.int32) for x, y in zip(a.tolist(), b.tolist(), strict=True)],
        }
        sequence += len(cuts) - 1
        left = int(np.searchsorted(ends, stop, side="right"))
        if left == len(parts):
            keys, starts, parts, totals, held = [], [], [], [], 0
            return
        done = stop - int(begin[left])
        keys, totals = keys[left:], totals[left:]
        starts = [starts[left] + done, *starts[left + 1 :]]
        parts = [parts[left][done:], *parts[left + 1 :]]
        held = sum(map(len, parts))

    for own_keys, texts in batches:
        for k, ids in zip(own_keys, enc.batch(texts), strict=True):
            keys.append(k)
            starts.append(0)
            parts.append(ids)
            totals.append(len(ids))
            held += len(ids)
            if held >= block:
                yield from packed(False)
    yield from packed(True)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A document's ids are those of its text and the id END; a null or empty text is END alone. Sequences take
    documents in the order of the input's splits and hold ``length`` ids at most; each split ends its last
    sequence. ``sequence_id`` is the split's number times 2^40 plus the sequence's. Keys may repeat or be null:
    each row is packed for itself. ``tokenizer``: path of a tokenizer file that every executor can read.
    ``length`` is 1 or more.
    """
    if length < 1:
        raise ValueError("a sequence holds one token at least")
    path = tokenizer or default_tokenizer()
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, split = ids_of(path), TaskContext.get().partitionId()
        for p in pack_stream(((b["k"].tolist(), b["t"].tolist()) for b in batches), enc, length):
            out = {
                "k": pd.Series(p["key"], dtype="Int64" if kind in ("bigint", "int") else "object"),
                "start": p["start"],
                "length": p["length"],
                "ids_crc32": np.array(p["ids_crc32"], np.int64),
                "doc_tokens": p["doc_tokens"],
                "sequence_id": (split << 40) + p["sequence"],
                "offset": p["offset"],
            }
            yield pd.DataFrame(out | ({"ids": p["ids"]} if with_ids else {}))

    schema = f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    return rows.mapInPandas(run, schema + (", ids array<int>" if with_ids else "")).withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


#: Token ids are beyond SQL; the tests encode and pack anew, by brute force.
SQL = None
