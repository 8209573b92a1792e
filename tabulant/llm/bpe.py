"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its inverse.

A sequence of tokens is what the merge list makes of its bytes exactly if each pair of
neighbours is. So the encoding of every prefix ends in one token that can be found from
the encodings of shorter prefixes, and a longer text never changes how a prefix is encoded
up to one of its own token ends. Every encoding has a token end among the last
`lookahead` positions (the bytes of the longest token); what all of those trace back to
is stable and is emitted, and only what follows is kept.
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulant.llm.common import texts

PRE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
CACHED = 400_000


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def tables(source: str) -> dict:
    """Plain tables of a tokenizer file: bytes of each token, how it was made, what pairs become."""
    data = json.loads(source)
    model, char = data["model"], byte_characters()
    raw = lambda s: bytes(char[c] for c in s)
    added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    ids = {raw(t): i for t, i in model["vocab"].items() if i not in added.values()}
    rank, made, when = {}, {}, {}
    for k, m in enumerate(model["merges"]):
        a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
        whole = ids[a + b]
        rank[ids[a] << 32 | ids[b]] = k
        if whole not in made:
            made[whole], when[whole] = (ids[a], ids[b]), k
    return {"ids": ids, "added": added, "rank": rank, "made": made, "when": when}


class Merges:
    """A merge list and what it makes of pre-tokens.

    `shared` is the result of `tables`; what is found out about pairs stays in it, so it
    serves all tasks of a worker.
    """

    def __init__(self, shared: dict):
        self.ids, self.added = shared["ids"], shared["added"]
        self.rank, self.made, self.when = shared["rank"], shared["made"], shared["when"]
        self._fits: dict[int, bool] = shared.setdefault("fits", {})
        # each start of a token, with the length of the longest token that it starts with
        self.heads: dict[bytes, int] = shared.setdefault("heads", {})
        if not self.heads:
            for t in self.ids:
                best = 0
                for n in range(1, len(t) + 1):
                    best = n if t[:n] in self.ids else best
                    self.heads[t[:n]] = best
        self.lookahead = max(map(len, self.ids))

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together are encoded as just these two.

        The merges that made them are undone from the latest to the earliest. The pair
        falls if two pieces that meet at the seam could have merged before the merge
        undone last.
        """
        code = left << 32 | right
        known = self._fits.get(code)
        if known is not None:
            return known
        a, b, undone = left, right, len(self.rank)
        ok = True
        while True:
            k = self.rank.get(a << 32 | b)
            # at equal rank the pair further left goes first, so a merge undone on the
            # right side loses against its equal at the seam
            if k is not None and k < undone:
                ok = False
                break
            when_a, when_b = self.when.get(a, -1), self.when.get(b, -1)
            if when_a < 0 and when_b < 0:
                break
            if when_a > when_b:
                a, undone = self.made[a][1], when_a
            else:
                b, undone = self.made[b][0], when_b + 1
        if len(self._fits) > 2 * CACHED:
            self._fits.clear()
        self._fits[code] = ok
        return ok

    def stream(self, chunks: Iterator[bytes]) -> Iterator[int]:
        """Tokens of one pre-token whose bytes come in pieces, each emitted once stable."""
        ids, fits, most = self.ids, self.fits, self.lookahead
        text = bytearray()
        size = [0]  # bytes of the last token of each prefix
        last = [-1]
        for chunk in chunks:
            text += chunk
            for i in range(len(last), len(text) + 1):
                for n in range(min(i, most), 0, -1):
                    token = ids.get(bytes(text[i - n : i]))
                    if token is not None and (last[i - n] < 0 or fits(last[i - n], token)):
                        size.append(n)
                        last.append(token)
                        break
            if len(text) > 4 * most:
                # where all possible token ends trace back to
                ends = set(range(len(text) - most + 1, len(text) + 1))
                while len(ends) > 1:
                    top = max(ends)
                    ends.discard(top)
                    ends.add(top - size[top])
                stable = ends.pop()
                if stable:
                    yield from self._path(last, size, stable)
                    keep = last[stable]
                    del text[:stable]
                    size, last = size[stable:], last[stable:]
                    size[0], last[0] = 0, keep
        yield from self._path(last, size, len(text))

    @staticmethod
    def _path(last: list[int], size: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def piece(self, piece: bytes) -> list[int]:
        """A pre-token that is in memory as a whole.

        A long one is streamed. In a short one the end is in sight: the longest token that
        fits its left neighbour is taken, and given up for a shorter one if nothing fits
        after it; positions where that happened are not tried again.
        """
        if len(piece) > 4 * self.lookahead:
            step = self.lookahead
            return list(self.stream(piece[i : i + step] for i in range(0, len(piece), step)))
        ids, heads, known = self.ids, self.heads, self._fits
        whole = ids.get(piece)
        if whole is not None and whole not in self.made:
            return [whole]
        out: list[int] = []
        ends = [0]
        dead: set[int] = set()
        at = 0
        limit = total = len(piece)
        while at < total:
            n = 1
            longest = 0
            while at + n <= limit:
                got = heads.get(piece[at : at + n])
                if got is None:
                    break
                longest = got
                n += 1
            n = longest
            left = out[-1] << 32 if out else -1
            while n:
                token = ids[piece[at : at + n]]
                if at + n not in dead:
                    ok = left < 0 or known.get(left | token)
                    if ok is None:
                        ok = self.fits(out[-1], token)
                    if ok:
                        out.append(token)
                        at += n
                        ends.append(at)
                        limit = total
                        break
                n = heads[piece[at : at + n - 1]] if n > 1 else 0
            else:
                dead.add(at)
                out.pop()
                limit = ends.pop() - 1
                at = ends[-1]
        return out


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows)))


def encoder(shared):
    """`shared.value` holds `tables` and is kept by a worker from task to task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(shared.value)
        known: dict[str, bytes] = shared.value.setdefault("known", {})
        names = sorted(merges.added, key=len, reverse=True)
        cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        pieces_of = PRE.findall

        def plain(text: str) -> bytes:
            pieces = pieces_of(text)
            new = set(pieces).difference(known)
            if len(known) + len(new) > CACHED:
                known.clear()
                new = set(pieces)
            for p in new:
                known[p] = array("i", merges.piece(p.encode())).tobytes()
            out = b"".join(map(known.__getitem__, pieces))
            for p in new:
                if len(p) > 64:
                    del known[p]
            return out

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = []
                for text in part.column("text").to_pylist():
                    out = [
                        plain(t) if i % 2 == 0 else np.int32(merges.added[t]).tobytes()
                        for i, t in enumerate(cut.split(text) if cut else [text])
                    ]
                    rows.append(np.frombuffer(b"".join(out), np.int32))
                yield pa.record_batch([part.column("id"), _lists(rows)], names=["doc_id", "ids"])

    return run


def decoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: t for t, i in shared.value["ids"].items()}
        token |= {i: s.encode() for s, i in shared.value["added"].items()}
        none = max(token, default=-1) + 1  # stands for numbers that are no token
        of = [token.get(i, b"") for i in range(none + 1)]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = []
                for ids in part.column("ids"):
                    state = codecs.getincrementaldecoder("utf-8")("replace")
                    ids = ids.values.fill_null(none).to_numpy() if ids.is_valid else np.zeros(0, int)
                    ids = np.where((ids >= 0) & (ids < none), ids, none)
                    pieces = [
                        state.decode(b"".join(map(of.__getitem__, ids[k : k + 4096].tolist())))
                        for k in range(0, len(ids), 4096)
                    ]
                    out.append("".join(pieces) + state.decode(b"", True))
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("ids"), pa.array(out, pa.string())],
                    names=["doc_id", "ids", "text"],
                )

    return run


def load(spark: SparkSession, path: str):
    """The tables of the tokenizer file (some MB, read on the driver), for all workers."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(tables(f.read()))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `ids` (array of int): each whole text under the tokenizer file at `path`.

    The file is a byte-level merge list of a few MB. Strings of added tokens in a text become their ids. There is no shuffle; a
    worker keeps one text, the tables and a bounded table of pre-tokens met before.

    Null text: empty, no tokens. Repeated rows give a row each, an empty table none; null
    ids stay null; other columns are ignored.
    """
    shared = load(docs.sparkSession, path)
    return texts(docs, key, text).mapInArrow(encoder(shared), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, ids and the text they stand for. Bytes that are no UTF-8 become U+FFFD.

    A decoder that keeps its state between pieces turns bytes into characters, so a
    character may be spread over tokens. Null ids: empty text; numbers that are no token
    stand for nothing.
    """
    shared = load(tokens.sparkSession, path)
    rows = tokens.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.col(f"`{ids}`").cast("array<int>").alias("ids"),
    )
    return rows.mapInArrow(decoder(shared), "doc_id long, ids array<int>, text string")
