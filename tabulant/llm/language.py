"""Language identification with a linear-chain conditional random field over words.

Each word gets a score per language from its byte n-grams, affixes and, if it is in the
lexicon, the word itself; transitions between neighbours are learned too. Forward-backward
gives every word's distribution over languages, also in text that switches between them;
the document takes the language with the largest share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.llm.common import document_chunks, mix, texts
from tabulant.llm.samples import bottom_sample

WORD = regex.compile(r"\p{L}+")
LANE = 128  # words that one lane of the side-by-side passes holds
CACHED = 200_000
SCORED = 20_000  # words whose features are in memory at once
NONE = "und"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_features(words: list[str], bits: int, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, flat, and where each word's features start.

    Hashed 1- to 4-grams of the UTF-8 bytes with a mark at both ends, the affixes of four
    bytes, and a number above 2**bits for a word of the lexicon (sorted hashes).
    """
    coded = [b"\x01" + w.encode() + b"\x02" for w in words]
    size = np.array([len(c) for c in coded])
    end = np.cumsum(size)
    start = end - size
    data = np.frombuffer(b"".join(coded) + b"\0\0\0\0\0", np.uint8).astype(np.uint64)
    n = int(end[-1]) if len(words) else 0
    word = np.repeat(np.arange(len(words)), size)
    mask = np.uint64((1 << bits) - 1)
    gram = np.zeros(n, np.uint64)
    ids, owners = [], []
    left = end[word] - np.arange(n)
    for k in range(4):
        gram = (gram << np.uint64(8)) | data[k : k + n]
        ok = left > k
        ids.append((mix(gram + np.uint64(k << 40)) & mask)[ok])
        owners.append(word[ok])
    head, tail = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    whole = np.zeros(len(words), np.uint64)
    for k in range(5):
        inside = size > k
        head[inside] = head[inside] << np.uint64(8) | data[start[inside] + k]
        tail[inside] = tail[inside] << np.uint64(8) | data[end[inside] - 1 - k]
    for k in range(int(size.max(initial=0))):
        inside = size > k
        whole[inside] = mix(whole[inside] + data[start[inside] + k] + np.uint64(1))
    ids += [mix(head + np.uint64(7 << 50)) & mask, mix(tail + np.uint64(9 << 50)) & mask]
    owners += [np.arange(len(words))] * 2
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
        known = lexicon[at] == whole
        ids.append((at[known] + (1 << bits)).astype(np.uint64))
        owners.append(np.flatnonzero(known))
    flat, owner = np.concatenate(ids).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.searchsorted(owner[order], np.arange(len(words)))


def word_hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    coded = [b"\x01" + w.encode() + b"\x02" for w in words]
    size = np.array([len(c) for c in coded], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    for k in range(int(size.max(initial=0))):
        inside = size > k
        out[inside] = mix(out[inside] + data[start[inside] + k] + np.uint64(1))
    return out


def word_scores(words: list[str], weights: np.ndarray, bits: int, lexicon: np.ndarray) -> np.ndarray:
    out = []
    for i in range(0, len(words), 20_000):
        flat, starts = word_features(words[i : i + 20_000], bits, lexicon)
        out.append(np.add.reduceat(weights[flat], starts, axis=0))
    return np.concatenate(out) if out else np.zeros((0, weights.shape[1]), np.float32)


def forward(e: np.ndarray, active: list[int], t: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Scaled forward vectors of lanes (sorted by falling length; active[i]: lanes longer than i)."""
    a = np.zeros_like(e)
    now = begin
    for i, n in enumerate(active):
        now = (now[:n] @ t) * e[:n, i]
        now /= now.sum(1, keepdims=True)
        a[:n, i] = now
    return a


def backward(e, active, t, a, finish, pairs: np.ndarray | None = None, each: np.ndarray | None = None):
    """Sum over each lane of the words' distributions; adds up transitions if `pairs` is given."""
    b = finish.copy()
    total = np.zeros_like(b)
    for i in range(len(active) - 1, -1, -1):
        n = active[i]
        m = active[i + 1] if i + 1 < len(active) else 0
        if m:
            q = e[:m, i + 1] * b[:m]
            if pairs is not None:
                z = ((a[:m, i] @ t) * q).sum(1, keepdims=True)
                pairs += t * ((a[:m, i] / z).T @ q)
            q = q @ t.T
            b[:m] = q / q.sum(1, keepdims=True)
        g = a[:n, i] * b[:n]
        g /= g.sum(1, keepdims=True)
        total[:n] += g
        if each is not None:
            each[:n, i] = g
    return total


def document_shares(scores: np.ndarray, counts: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Mean distribution over languages of each document's words, by forward-backward.

    `scores`: one row per word, document after document. Documents are cut into lanes that
    run side by side; the product of a lane's step matrices carries the state across its
    borders, so the result is that of one pass over the whole text.
    """
    k = t.shape[0]
    t = t.astype(np.float32)
    out = np.zeros((len(counts), k))
    if not len(scores):
        return out
    e = (np.exp(scores - scores.max(1, keepdims=True)) + 1e-6).astype(np.float32)
    blocks = -(-counts // LANE)
    first = np.cumsum(blocks) - blocks
    doc = np.repeat(np.arange(len(counts)), blocks)
    index = np.arange(len(doc)) - first[doc]
    offset = (np.cumsum(counts) - counts)[doc] + index * LANE
    length = np.minimum(counts[doc] - index * LANE, LANE)
    order = np.argsort(-length, kind="stable")
    place = np.minimum(offset[order, None] + np.arange(LANE), len(e) - 1)
    lanes = e[place]
    active = [int(n) for n in (length[:, None] > np.arange(LANE)).sum(0) if n]
    # products of the steps of each lane
    m = np.broadcast_to(np.eye(k, dtype=np.float32), (len(doc), k, k)).copy()
    if blocks.max() > 1:
        for i, n in enumerate(active):
            x = (m[:n].reshape(-1, k) @ t).reshape(n, k, k) * lanes[:n, i, None, :]
            m[:n] = x / x.sum((1, 2), keepdims=True)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    begin = np.full((len(doc), k), 1 / k, np.float32)
    finish = np.ones((len(doc), k), np.float32)
    now, later = np.full((len(counts), k), 1 / k), np.ones((len(counts), k))
    for j in range(int(blocks.max())):
        d = np.flatnonzero(blocks > j)
        lane = back[first[d] + j]
        begin[lane] = now[d]
        x = np.einsum("nk,nkl->nl", now[d], m[lane])
        now[d] = x / x.sum(1, keepdims=True)
        lane = back[first[d] + blocks[d] - 1 - j]
        finish[lane] = later[d]
        x = np.einsum("nkl,nl->nk", m[lane], later[d])
        later[d] = x / x.sum(1, keepdims=True)
    a = forward(lanes, active, t, begin)
    total = backward(lanes, active, t, a, finish)
    np.add.at(out, doc[order], total)
    return out / np.maximum(counts, 1)[:, None]


def fit(rows: list[tuple[str, str]], bits: int, passes: int, most: int, rate: float = 0.1) -> dict:
    """Weights and transitions from (text, language) rows; `most` bounds the sequences."""
    langs = sorted({lang for _, lang in rows})
    k = len(langs)
    code = {lang: i for i, lang in enumerate(langs)}
    number: dict[str, int] = {}
    half = LANE // 2
    pieces = []
    for text, lang in rows:
        ids = [number.setdefault(w, len(number)) for w in words_of(text)]
        pieces += [(ids[i : i + half], code[lang]) for i in range(0, len(ids), half)]
    rng = np.random.default_rng(7)
    order = rng.permutation(len(pieces))[: 2 * most]
    # two pieces of any two documents make a sequence, so that switches are seen
    pairs = [(pieces[a], pieces[b]) for a, b in zip(order[::2], order[1::2])] or [
        (p, ([], 0)) for p in pieces
    ]
    pairs.sort(key=lambda p: -len(p[0][0]) - len(p[1][0]))
    words = list(number)
    seen = Counter(i for p, _ in pieces for i in p)
    common = [words[i] for i, n in seen.items() if n >= 5]
    lexicon = np.unique(word_hashes(common)) if common else np.zeros(0, np.uint64)
    flat, starts = word_features(words, bits, lexicon)
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(flat))))
    width = (1 << bits) + len(lexicon)
    at = np.zeros((len(pairs), LANE), np.int64)
    gold = np.full((len(pairs), LANE), -1)
    for i, ((x, cx), (y, cy)) in enumerate(pairs):
        at[i, : len(x) + len(y)] = x + y
        gold[i, : len(x)] = cx
        gold[i, len(x) : len(x) + len(y)] = cy
    inside = gold >= 0
    active = [int(n) for n in inside.sum(0) if n]
    want = np.zeros((k, k))
    both = inside[:, 1:] & inside[:, :-1]
    np.add.at(want, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    hot = np.zeros((*gold.shape, k))
    hot[inside, gold[inside]] = 1
    params = [np.zeros((width, k)), np.zeros((k, k))]
    slow = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    n_words = max(1, int(inside.sum()))
    for step in range(1, passes + 1):
        scores = np.add.reduceat(params[0][flat], starts, axis=0) if len(flat) else np.zeros((0, k))
        s = scores[at]
        e = np.exp(s - s.max(2, keepdims=True)) + 1e-6
        t = np.exp(params[1])
        a = forward(e, active, t, np.full((len(pairs), k), 1.0 / k))
        got, each = np.zeros((k, k)), np.zeros_like(e)
        backward(e, active, t, a, np.ones((len(pairs), k)), got, each)
        miss = (hot - each)[inside]
        per_word = np.stack(
            [np.bincount(at[inside], miss[:, j], len(words)) for j in range(k)], axis=1
        )
        g0 = np.stack([np.bincount(flat, per_word[owner, j], width) for j in range(k)], axis=1)
        grads = [g0 / n_words - 1e-7 * params[0], (want - got) / n_words - 1e-6 * params[1]]
        for p, g, (m, v) in zip(params, grads, slow):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return {
        "langs": langs,
        "weights": params[0].astype(np.float32),
        "transitions": np.exp(params[1]),
        "lexicon": lexicon,
        "bits": bits,
    }


def train(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    sample: int = 1500,
    sequences: int = 2500,
    bits: int = 16,
    passes: int = 15,
) -> dict:
    """Fit the field on at most `sample` labelled rows (whole texts) and `sequences` sequences.

    The bounds keep the fit on the driver small whatever the input; rows with a null or
    empty text or a null language are not used. Languages that the sample lacks are not
    learned. Without any labelled row every document is `und`.
    """
    rows = labelled.select(
        F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")
    ).where("t is not null and l is not null and t rlike '\\\\p{L}'")
    got = bottom_sample(rows, F.xxhash64("t", "l"), sample).collect()
    got = sorted((r.t, r.l) for r in got)
    if not got:
        return {"langs": []}
    return fit(got, bits, passes, sequences)


def _labeller(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = model["langs"]
        k = len(langs)
        if "rows" not in model:
            model["rows"], model["table"] = {}, np.zeros((CACHED, k), np.float32)
        known, scores_of = model["rows"], model["table"]
        for ids, bodies in document_chunks(batches, 1 << 20):
            found = [words_of(b.decode()) for b in bodies]
            counts = np.array([len(w) for w in found])
            shares = np.zeros((len(ids), k))
            if k and counts.sum():
                rows = []
                for words in _runs(found):
                    new = set(words).difference(known)
                    if len(known) + len(new) > CACHED:
                        known.clear()
                        new = set(words)
                    fresh = sorted(new)
                    for i in range(0, len(fresh), SCORED):
                        part = fresh[i : i + SCORED]
                        base = len(known)
                        known.update(zip(part, range(base, base + len(part))))
                        scores_of[base : base + len(part)] = word_scores(
                            part, model["weights"], model["bits"], model["lexicon"]
                        )
                    index = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    rows.append(scores_of[index])
                shares = document_shares(
                    np.concatenate(rows), counts, model["transitions"]
                )
            best = shares.argmax(1) if k else np.zeros(len(ids), int)
            named = [langs[b] if k and n else NONE for b, n in zip(best.tolist(), counts.tolist())]
            score = [float(s[b]) if k and n else 0.0 for s, b, n in zip(shares, best, counts)]
            parts = [
                [{"lang": langs[j], "share": float(s[j])} for j in range(k)] if n else []
                for s, n in zip(shares, counts.tolist())
            ]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(named, pa.string()),
                    pa.array(np.clip(score, 0, 1), pa.float64()),
                    pa.array(counts, pa.int64()),
                    pa.array(parts, kind),
                ],
                names=["doc_id", "lang_pred", "score", "n_words", "shares"],
            )

    return run


def _runs(found: list[list[str]], most: int = CACHED // 2) -> Iterator[list[str]]:
    """All words in order, in runs short enough for their scores to be in the table at once."""
    run: list[str] = []
    for words in found:
        for i in range(0, len(words), most):
            part = words[i : i + most]
            if len(run) + len(part) > most:
                yield run
                run = []
            run = run + part if run else list(part)
    if run:
        yield run


def identify(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, n_words and the share of each language among the words.

    Reads the text alone. `score` is the share of the predicted language (0 to 1). Texts
    that are null or have no letter are `und` with score 0 and no shares. The model (size
    fixed by the parameters of `train`) goes to the workers; there is no shuffle. Repeated
    rows give a row each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = (
        "doc_id long, lang_pred string, score double, n_words long, "
        "shares array<struct<lang:string,share:double>>"
    )
    return texts(docs, key, text).mapInArrow(_labeller(shared), schema)
