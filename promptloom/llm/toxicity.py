"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Each word enters as a word vector (hashed) joined to a character vector (the sum of
hashed vectors of its 3- and 5-byte grams, with word boundaries, over the root of
their number). A GRU (with the hard sigmoid and hard tangent, which cost no
exponentials) reads a window of words in both directions, attention pools its states,
and one logit comes out. A document's logit is the largest over all its overlapping
windows, one from every word; scores are calibrated so that the decision line is at 0.7.

Training reads every labelled row that is not held out, but for a quarter: its whole
text, however long. First the documents with each word and gram are counted. Then come
``ROUNDS`` turns; each deals its rows into pieces of about ``PIECE_ROWS``, every piece is
trained on by plain numpy in a task of its own, from the same weights on, and the changes
are averaged (of a word or gram: over the pieces that met it). With more than
``PIECE_ROWS`` rows a row takes part in fewer turns, in one at least. Labels mark whole
documents: a toxic document gives its most suspicious window as an example, first by the
log odds its grams have, later by the network itself; clean documents give clean windows.

The quarter of the labelled rows that takes no part in training sets the decision line:
all of it is scored on the executors, and counted by logit in steps of 1 / ``FINE``.
Scoring runs on the executors and reads every whole text.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from promptloom.llm import textnum as tn
from promptloom.llm.common import scratch, stash
from promptloom.shared import in_blocks
from promptloom.shipping import ship

#: Rows of a piece of a turn; steps of a logit, by which the decision line is set.
PIECE_ROWS, FINE = 2400, 1024
#: Bytes of labelled ids that are sent to every executor at once.
SENT_BYTES = 32 << 20
#: Words of a window, and words from one window that training may take as an example to the
#: next; scoring looks at every window.
WINDOW, STRIDE = 10, 5
WORDS, WORD_DIM = 1 << 15, 8
GRAMS, GRAM_DIM = 1 << 16, 16
HIDDEN, ATTEND = 10, 10
#: A piece goes over all its examples in each of ROUNDS turns, in STEPS batches at least; the
#: windows are picked anew for each turn.
ROUNDS, STEPS, BATCH, SEED = 5, 20, 256, 11
#: Empty texts that training adds to each piece as clean rows.
EMPTY = 16
LINE = 0.7
BLOCK = 2048
#: Texts, their characters, distinct words and windows that training looks at together, to bound memory.
TEXT_BLOCK, TEXT_CHARS, WORD_BLOCK, WINDOW_BLOCK = 100, 1 << 20, 20_000, 1 << 16
#: Distinct words whose inputs a scoring task keeps from one batch of texts to the next, and grams of
#: a word up to which words are summed side by side.
KNOWN_WORDS, MANY_GRAMS = 1 << 17, 64
#: Parts of the model with a row for each slot.
TABLES = {"words": WORDS, "grams": GRAMS}

#: Bytes that end a word, after lower-casing: ASCII other than letters and digits.
SEPARATORS = tn.byte_class(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))


def distinct_words(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``np.unique`` with index and inverse, sorting each value only once."""
    coded = pa.array(hashes).dictionary_encode()
    values, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    at, order = np.empty(len(values), np.int64), np.argsort(values)
    at[which[::-1]] = np.arange(len(hashes))[::-1]  # the first place is written last
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return values[order], at[order], rank[which]


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, words, spans): per row the number of its first word; per word the number of
    its distinct word; and the bytes of the distinct words, marked at both ends, as
    (buffer, offsets) in ``spans``."""
    lowered = pc.utf8_lower(texts.fill_null("")).cast(pa.large_binary())
    ends = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    data = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts, stops, first = tn.words(data, ends - ends[0], SEPARATORS)
    hashes, at, which = distinct_words(tn.word_hashes(data, starts, stops))
    sizes = stops[at] - starts[at] + 2
    offsets = np.append(0, np.cumsum(sizes))
    buffer = np.full(offsets[-1], 1, np.uint8)
    inner = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
    body = (inner > 0) & (inner < np.repeat(sizes, sizes) - 1)
    buffer[body] = data[(np.repeat(starts[at], sizes) + inner - 1)[body]]
    return first, which, (hashes, buffer, offsets)


def gram_ids(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, owner) of the 3- and 5-byte grams of marked words, sorted by owner."""
    ids, owners = [], []
    sizes = np.diff(offsets)
    wide = buffer.astype(np.uint64)
    for n in (3, 5):
        count = np.maximum(sizes - n + 1, 0)
        owner = np.repeat(np.arange(len(sizes)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][owner]
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(257) + wide[at + k]
        ids.append((tn.mix(h) % np.uint64(GRAMS)).astype(np.int64))
        owners.append(owner)
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], owners[order]


def features(spans: tuple, model: dict, side_by_side: bool = False) -> tuple[np.ndarray, tuple]:
    """Input vectors of distinct words, and what their gradient needs. Grams summed
    ``side_by_side`` take half the time, but round otherwise; over its many steps training
    would make a visible difference of that."""
    hashes, buffer, offsets = spans
    word = (hashes % np.uint64(WORDS)).astype(np.int64)
    grams, owner = gram_ids(buffer, offsets)
    count = np.bincount(owner, minlength=len(word))
    scale = (1 / np.sqrt(np.maximum(count, 1))).astype(np.float32)
    if side_by_side:
        summed = sum_grams(model["grams"], grams, count)
    else:
        first = np.minimum(np.cumsum(count) - count, max(len(grams) - 1, 0))
        summed = np.add.reduceat(model["grams"][grams], first, axis=0) if len(grams) else np.zeros((len(word), GRAM_DIM), np.float32)
        summed[count == 0] = 0
    return np.hstack([model["words"][word], summed * scale[:, None]]), (word, grams, owner, scale)


def sum_grams(table: np.ndarray, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per word the sum of its ``count`` rows of ``table``: first all words' first ones, then
    all second ones; the few words with over MANY_GRAMS are summed one by one."""
    first = np.cumsum(count) - count
    summed = np.zeros((len(count), GRAM_DIM), np.float32)
    usual = np.flatnonzero(count <= MANY_GRAMS)
    usual = usual[np.argsort(-count[usual], kind="stable")]
    upto = np.searchsorted(-count[usual], -np.arange(count[usual].max(initial=0)), "left")
    made = np.zeros((len(usual), GRAM_DIM), np.float32)
    for k, n in enumerate(upto):
        made[:n] += table.take(grams[first[usual[:n]] + k], axis=0)
    summed[usual] = made
    for at in np.flatnonzero(count > MANY_GRAMS):
        summed[at] = np.add.reduceat(table[grams[first[at] : first[at] + count[at]]], [0], axis=0)[0]  # rounds as in training
    return summed


def windows(first: np.ndarray, stride: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, size) of the windows, one every ``stride`` words: words start .. start +
    size of the batch. The last one of a row ends with it; a row without words has one
    empty window."""
    n = np.diff(first)
    count = np.where(n <= WINDOW, 1, 1 + -(-(n - WINDOW) // stride))
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * stride, np.maximum(n[row] - WINDOW, 0))
    return row, first[:-1][row] + start, np.minimum(n[row] - start, WINDOW)


def fresh_model(rng: np.random.Generator) -> dict:
    d, h = WORD_DIM + GRAM_DIM, HIDDEN
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    model = {"words": rng.normal(0, 0.05, (WORDS, WORD_DIM)).astype(np.float32), "grams": rng.normal(0, 0.05, (GRAMS, GRAM_DIM)).astype(np.float32)}
    for way in "fb":
        model |= {f"W{way}": draw(d, 3 * h), f"b{way}": np.zeros(3 * h, np.float32), f"U{way}": draw(h, 3 * h)}
    return model | {"A": draw(2 * h, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": draw(ATTEND), "w": draw(2 * h), "bias": np.zeros(1, np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gate(x: np.ndarray) -> np.ndarray:
    """The hard sigmoid."""
    return np.clip(0.5 + 0.25 * x, 0, 1)


def squash(x: np.ndarray) -> np.ndarray:
    """The hard tangent."""
    return np.clip(x, -1, 1)


def recur(inputs: np.ndarray, mask: np.ndarray, U: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction. inputs: time x batch x 3h, with bias; mask: time x batch."""
    h = U.shape[0]
    state, states, tape = np.zeros((inputs.shape[1], h), inputs.dtype), np.empty((*inputs.shape[:2], h), inputs.dtype), []
    for t in range(len(inputs)):
        gates = gate(inputs[t, :, : 2 * h] + state @ U[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        c = squash(inputs[t, :, 2 * h :] + (r * state) @ U[:, 2 * h :])
        new = c + z * (state - c)
        m = mask[t][:, None]
        if keep:
            tape.append((state, z, r, c))
        state = np.where(m, new, state)
        states[t] = state
    return states, tape


def recur_back(grad: np.ndarray, mask: np.ndarray, U: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of inputs and U."""
    h = U.shape[0]
    d_in, dU = np.zeros((*grad.shape[:2], 3 * h), grad.dtype), np.zeros_like(U)
    carry = np.zeros(grad.shape[1:], grad.dtype)
    for t in reversed(range(len(grad))):
        state, z, r, c = tape[t]
        carry = carry + grad[t]
        m = mask[t][:, None]
        g = carry * m
        dc = g * (1 - z) * (np.abs(c) < 1)
        dz = g * (state - c) * 0.25 * ((z > 0) & (z < 1))
        rs = dc @ U[:, 2 * h :].T
        dr = rs * state * 0.25 * ((r > 0) & (r < 1))
        dU[:, 2 * h :] += (r * state).T @ dc
        both = np.hstack([dz, dr])
        dU[:, : 2 * h] += state.T @ both
        d_in[t] = np.hstack([both, dc])
        carry = carry * ~m + g * z + rs * r + both @ U[:, : 2 * h].T
    return d_in, dU


def forward(model: dict, per_word: np.ndarray, index: np.ndarray, size: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Logits of windows. per_word: projected inputs of distinct words (6h), index: time x
    batch, the distinct word at each place; size: words of each window."""
    h3 = 3 * HIDDEN
    mask = np.arange(len(index))[:, None] < size[None, :]
    fwd, tape_f = recur(per_word[index, :h3], mask, model["Uf"], keep)
    bwd, tape_b = recur(per_word[index[::-1], h3:], mask[::-1], model["Ub"], keep)
    both = np.concatenate([fwd, bwd[::-1]], 2)
    e = squash(both @ model["A"] + model["a"])
    score = np.where(mask, e @ model["v"], -1e9)
    alpha = np.exp(score - score.max(0)) * mask
    alpha /= np.maximum(alpha.sum(0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", alpha, both)
    return pooled @ model["w"] + model["bias"][0], (mask, tape_f, tape_b, both, e, alpha, pooled)


def project(model: dict, x: np.ndarray) -> np.ndarray:
    return np.hstack([x @ model["Wf"] + model["bf"], x @ model["Wb"] + model["bb"]])


def gradients(model: dict, x: np.ndarray, index: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
    """Of the weighted logistic loss: by weights of the network, and by the words' inputs x."""
    logit, (mask, tape_f, tape_b, both, e, alpha, pooled) = forward(model, project(model, x), index, size, keep=True)
    d = ((sigmoid(logit) - y) * weight / weight.sum()).astype(x.dtype)
    g = {"w": pooled.T @ d, "bias": d.sum(keepdims=True)}
    d_pool = d[:, None] * model["w"]
    d_both = alpha[:, :, None] * d_pool[None]
    d_alpha = np.einsum("tbh,bh->tb", both, d_pool)
    d_score = alpha * (d_alpha - (alpha * d_alpha).sum(0))
    d_e = d_score[:, :, None] * model["v"] * (np.abs(e) < 1)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    g |= {"v": np.einsum("tb,tba->a", d_score, e), "A": flat(both).T @ flat(d_e), "a": d_e.sum((0, 1))}
    d_both = d_both + d_e @ model["A"].T
    d_f, g["Uf"] = recur_back(d_both[:, :, :HIDDEN], mask, model["Uf"], tape_f)
    d_b, g["Ub"] = recur_back(d_both[::-1, :, HIDDEN:], mask[::-1], model["Ub"], tape_b)
    d_b = d_b[::-1]
    dx = np.zeros_like(x)
    for way, grad in (("f", d_f), ("b", d_b)):
        summed = np.zeros((len(x), grad.shape[-1]), x.dtype)
        np.add.at(summed, index[mask], grad[mask])
        g |= {f"W{way}": x.T @ summed, f"b{way}": summed.sum(0)}
        dx += summed @ model[f"W{way}"].T
    return g, dx


def step(model: dict, moments: dict, index: np.ndarray, size: np.ndarray, spans: tuple, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """One step down the gradient (Adam; sparse Adagrad for the vectors)."""
    x, (word, grams, owner, scale) = features(spans, model)
    g, dx = gradients(model, x, index, size, y, weight)
    moments["t"] += 1
    for k, grad in g.items():
        m, v = moments.setdefault(k, [np.zeros_like(model[k]), np.zeros_like(model[k])])
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        model[k] -= rate * (m / (1 - 0.9 ** moments["t"])) / (np.sqrt(v / (1 - 0.99 ** moments["t"])) + 1e-8)
    for k, ids, grad in (("words", word, dx[:, :WORD_DIM]), ("grams", grams, (dx[:, WORD_DIM:] * scale[:, None])[owner])):
        rows, inverse = np.unique(ids, return_inverse=True)
        summed = np.zeros((len(rows), grad.shape[1]), np.float32)
        np.add.at(summed, inverse, grad)
        seen = moments.setdefault(k, np.zeros(len(model[k]), np.float32))
        seen[rows] += (summed * summed).mean(1)
        model[k][rows] -= 5 * rate * summed / (np.sqrt(seen[rows])[:, None] + 1e-6)


def window_logits(model: dict, texts: pa.Array, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, logit) of the windows of all texts."""
    first, which, spans = encode(texts)
    row, start, size = windows(first, stride)
    per_word = word_inputs(model, spans)
    padded = np.append(which, np.full(WINDOW, len(per_word) - 1))
    out = np.empty(len(row), np.float32)
    for at in range(0, len(row), BLOCK):
        part = slice(at, at + BLOCK)
        steps = int(size[part].max(initial=1)) or 1
        out[part] = forward(model, per_word, padded[start[part][None, :] + np.arange(steps)[:, None]], size[part])[0]
    return row, out


def word_inputs(model: dict, spans: tuple, known: dict | None = None) -> np.ndarray:
    """Projected inputs of distinct words (6h), and a last row of zeros. ``known`` keeps them from
    call to call, for the same model: up to KNOWN_WORDS words, then it starts anew."""
    hashes, made = spans[0], np.zeros((len(spans[0]) + 1, 6 * HIDDEN), np.float32)
    if known is None or len(hashes) > KNOWN_WORDS:
        made[:-1] = project(model, features(spans, model, known is not None)[0])
        return made
    if not known:
        known |= {"hashes": np.empty(0, np.uint64), "place": np.empty(0, np.int64), "rows": np.empty((KNOWN_WORDS, 6 * HIDDEN), np.float32)}
    at = np.searchsorted(known["hashes"], hashes)
    old = np.append(known["hashes"], np.uint64(0))[at] == hashes
    old &= at < len(known["hashes"])
    made[:-1][old] = known["rows"].take(known["place"][at[old]], axis=0)
    new = np.flatnonzero(~old)
    if len(new):
        made[new] = project(model, features(pick(spans, new), model, True)[0])
    if len(known["hashes"]) + len(new) > KNOWN_WORDS:
        known |= {"hashes": np.empty(0, np.uint64), "place": np.empty(0, np.int64)}
        at, new = np.zeros(len(hashes), np.int64), np.arange(len(hashes))
    n = len(known["hashes"])
    known["rows"][n : n + len(new)] = made[new]
    known["place"] = np.insert(known["place"], at[new], n + np.arange(len(new)))
    known["hashes"] = np.insert(known["hashes"], at[new], hashes[new])
    return made


def aligned(shape: tuple[int, ...]) -> np.ndarray:
    """An array whose first number begins a cache line: unaligned, sums and products take up to half as long again."""
    buffer = np.empty(4 * int(np.prod(shape)) + 64, np.uint8)
    begin = -buffer.ctypes.data % 64
    return buffer[begin : begin + 4 * int(np.prod(shape))].view(np.float32).reshape(shape)


def sweep_logits(model: dict, per_word: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``forward`` of the windows of WINDOW words at every place of ``words``. Neighbours
    start one word apart, so a step's inputs are a slice of the words' inputs. Of the
    states only their part in the next gates, the attention and the logit is kept. All
    steps write to the same few arrays."""
    h, out = HIDDEN, np.empty(max(len(words) - WINDOW + 1, 0), np.float32)
    scale, shift = np.repeat(np.array([[0.25, 1], [0.5, 0]], np.float32), (2 * h, h), axis=1)  # the hard sigmoid's
    tight = lambda a: np.ascontiguousarray(a, np.float32)
    kept, ways = np.hstack([model["A"], model["w"][:, None]]), []
    for at, way in enumerate("fb"):
        part, U, told = slice(3 * h * at, 3 * h * (at + 1)), model[f"U{way}"] * scale, kept[h * at : h * (at + 1)].T
        ways.append((tight(per_word[:, part] * scale + shift), tight(U[:, 2 * h :].T), tight(np.vstack([U[:, : 2 * h].T, told])), tight(told)))
    a = tight(model["a"])[:, None]
    space = lambda n: [aligned(shape) for shape in ((2 * h, n), (h, n), (h, n), (2 * h + ATTEND + 1, n), (WINDOW, ATTEND + 1, n), (3 * h, n + WINDOW - 1))]
    room = space(min(BLOCK, len(out)))
    for begin in range(0, len(out), BLOCK):
        n = min(BLOCK, len(out) - begin)
        g, c, state, made, seen, x = room if n == room[0].shape[1] else space(n)
        z, r, told, shown = g[:h], g[h:], made[: 2 * h], made[2 * h :]
        for at, (inputs, candidate, used, last) in enumerate(ways):
            np.copyto(x, inputs.take(words[begin : begin + n + WINDOW - 1], axis=0).T)
            for i, t in enumerate(reversed(range(WINDOW)) if at else range(WINDOW)):
                if i:
                    np.clip(np.add(x[: 2 * h, t : t + n], told, out=g), 0, 1, out=g)
                    np.matmul(candidate, np.multiply(r, state, out=r), out=c)
                    np.clip(np.add(c, x[2 * h :, t : t + n], out=c), -1, 1, out=c)
                    np.subtract(state, c, out=state)
                    np.add(np.multiply(state, z, out=state), c, out=state)
                else:  # from a state of zeros
                    np.clip(x[:h, t : t + n], 0, 1, out=z)
                    np.clip(x[2 * h :, t : t + n], -1, 1, out=c)
                    np.subtract(c, np.multiply(c, z, out=z), out=state)
                if i < WINDOW - 1:
                    np.matmul(used, state, out=made)
                else:  # no gates follow
                    np.matmul(last, state, out=shown)
                np.add(seen[t], shown, out=seen[t]) if at else np.copyto(seen[t], shown)
        e = np.add(seen[:, :ATTEND], a, out=seen[:, :ATTEND])
        score = np.matmul(model["v"], np.clip(e, -1, 1, out=e))
        alpha = np.exp(np.subtract(score, score.max(0), out=score), out=score)
        out[begin : begin + n] = (alpha * seen[:, ATTEND]).sum(0) / alpha.sum(0) + model["bias"][0]
    return out


def row_logits(model: dict, texts: pa.Array, known: dict | None = None) -> np.ndarray:
    """The largest logit of all windows of each text: every start is looked at. ``known``
    as for ``word_inputs``."""
    first, which, spans = encode(texts)
    size = np.diff(first)
    per_word = word_inputs(model, spans, known)
    best = np.empty(len(size), np.float32)
    short, long = np.flatnonzero(size < WINDOW), np.flatnonzero(size >= WINDOW)
    padded = np.append(which, np.full(WINDOW, len(per_word) - 1))
    for at in range(0, len(short), BLOCK):
        part = short[at : at + BLOCK]
        steps = int(size[part].max()) or 1
        best[part] = forward(model, per_word, padded[first[part][None, :] + np.arange(steps)[:, None]], size[part])[0]
    if len(long):
        logit = sweep_logits(model, per_word, which[np.repeat(size >= WINDOW, size)])
        begin = np.cumsum(size[long]) - size[long]
        # places whose window would run into the next row lie between the rows' own
        best[long] = np.maximum.reduceat(logit, np.stack([begin, np.minimum(begin + size[long] - WINDOW + 1, len(logit) - 1)], 1).ravel())[::2]
        best[long[-1]] = logit[begin[-1] :].max()
    return best


def text_blocks(texts: list[str]) -> list[pa.Array]:
    blocks, size = [], 0
    for text in texts:
        if not blocks or size + len(text) > TEXT_CHARS or len(blocks[-1]) >= TEXT_BLOCK:
            blocks.append([])
            size = 0
        blocks[-1].append(text)
        size += len(text)
    return [pa.array(block, pa.string()) for block in blocks]


def pick(spans: tuple, words: np.ndarray) -> tuple:
    """The spans of some of the distinct words."""
    sizes = np.diff(spans[2])[words]
    offsets = np.append(0, np.cumsum(sizes))
    source = np.repeat(spans[2][:-1][words] - offsets[:-1], sizes) + np.arange(offsets[-1])
    return spans[0][words], spans[1][source], offsets


def encode_blocks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple]:
    """``encode`` of all texts, a block at a time."""
    parts = [encode(block) for block in text_blocks(texts)]
    hashes, at, place = np.unique(np.concatenate([s[0] for _, _, s in parts]), return_index=True, return_inverse=True)
    sizes = np.concatenate([np.diff(s[2]) for _, _, s in parts])
    spans = pick((hashes[place], np.concatenate([s[1] for _, _, s in parts]), np.append(0, np.cumsum(sizes))), at)
    ends = np.cumsum([len(s[0]) for _, _, s in parts])
    which = np.concatenate([place[end - len(s[0]) : end][w] for end, (_, w, s) in zip(ends, parts, strict=True)])
    return np.append(0, np.cumsum(np.concatenate([np.diff(f) for f, _, _ in parts]))), which, spans


def distinct(values: np.ndarray) -> np.ndarray:
    """``np.unique`` by sorting, which takes a fraction of the time of its hash table."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def slot_counts(texts: pa.Array, toxic: np.ndarray) -> dict:
    """For each word and gram slot the toxic documents and all documents that have it."""
    first, which, spans = encode(texts)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # distinct (document, word)
    doc, word = np.divmod(distinct(doc * len(spans[0]) + which), max(len(spans[0]), 1))
    grams, owner = gram_ids(spans[1], spans[2])
    count = np.bincount(owner, minlength=len(spans[0]))
    many = count[word]
    begin = (np.cumsum(count) - count)[word]
    gram = grams[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)]
    slot = (spans[0] % np.uint64(WORDS)).astype(np.int64)[word]
    found = {}
    for k, d, ids in (("words", doc, slot), ("grams", np.repeat(doc, many), gram)):
        pair = distinct(d * TABLES[k] + ids)
        hit = toxic[pair // TABLES[k]]
        found[k] = np.stack([np.bincount(pair[hit] % TABLES[k], minlength=TABLES[k]), np.bincount(pair % TABLES[k], minlength=TABLES[k])])
    return found


def set_odds(model: dict, sums: dict, toxic: int, clean: int) -> None:
    """Start the first number of each word and gram slot at its log odds over so many
    documents, shrunk where few documents have it."""
    for k, (hit, total) in sums.items():
        raw = np.log((hit + 0.5) / (toxic + 1)) - np.log((total - hit + 0.5) / (clean + 1))
        model[k][:, 0] = np.clip(raw, -4, 4) * total / (total + 5)


def fresh_moments(model: dict) -> dict:
    zero = lambda k, v: np.zeros(len(v), np.float32) if k in TABLES else [np.zeros_like(v), np.zeros_like(v)]
    return {"t": 0} | {k: zero(k, v) for k, v in model.items()}


def train_piece(model: dict, moments: dict, texts: list[str], toxic: np.ndarray, turn: int, rng: np.random.Generator) -> None:
    """One turn over some rows; changes ``model`` and ``moments``."""
    texts, toxic = [*texts, *[""] * EMPTY], np.append(toxic, np.zeros(EMPTY, bool))
    first, which, spans = encode_blocks(texts)
    if not len(spans[0]):
        return
    row, start, size = windows(first, STRIDE)
    padded = np.append(which, np.zeros(WINDOW, np.int64))
    words_at = lambda part: padded[np.minimum(start[part][:, None] + np.arange(WINDOW), len(padded) - 1)]
    if turn < 2:
        blocks = [pick(spans, np.arange(at, min(at + WORD_BLOCK, len(spans[0])))) for at in range(0, len(spans[0]), WORD_BLOCK)]
        evidence = np.concatenate([*[features(b, model)[0][:, [0, WORD_DIM]].sum(1) for b in blocks], np.zeros(1, np.float32)])
        parts = [slice(at, at + WINDOW_BLOCK) for at in range(0, len(row), WINDOW_BLOCK)]
        suspicion = np.concatenate([np.where(np.arange(WINDOW) < size[p][:, None], evidence[words_at(p)], -9).max(1) for p in parts])
    else:
        suspicion = np.concatenate([window_logits(model, block, STRIDE)[1] for block in text_blocks(texts)])
    order = np.lexsort((-suspicion, row))
    top = order[np.append(True, row[order][1:] != row[order][:-1])]
    others = rng.permutation(np.flatnonzero(~toxic[row]))[: 2 * (~toxic).sum()]
    chosen = rng.permutation(np.concatenate([top, others]))
    target = toxic[row[chosen]].astype(np.float32)
    weight = np.where(target > 0, max(1.0, 0.5 * (target == 0).sum() / max(target.sum(), 1)), 1.0).astype(np.float32)
    for at in range(max(STEPS, -(-len(chosen) // BATCH))):
        batch = np.arange(at * BATCH, (at + 1) * BATCH) % len(chosen)
        part = chosen[batch]
        index = words_at(part).T
        used, local = np.unique(index, return_inverse=True)
        step(model, moments, local.reshape(index.shape), size[part], pick(spans, used), target[batch], weight[batch], 0.01 if turn < 3 else 0.004)


def changes(old: tuple[dict, dict], new: tuple[dict, dict]) -> bytes:
    """What a piece did to model and moments: all weights of the network, and the slots it met."""
    (model, moments), (made, moved) = old, new
    dense = {k: [made[k] - v, moved[k][0] - moments[k][0], moved[k][1] - moments[k][1]] for k, v in model.items() if k not in TABLES}
    met = {k: np.flatnonzero(moved[k] != moments[k]) for k in TABLES}
    slots = {k: (at.astype(np.int32), made[k][at] - model[k][at], moved[k][at] - moments[k][at]) for k, at in met.items()}
    return pickle.dumps((moved["t"], dense, slots))


def average(model: dict, moments: dict, pieces: Iterable[bytes]) -> None:
    """Move model and moments by the mean change; that of a slot is over the pieces that met it."""
    sums = {k: [np.zeros(v.shape) for _ in range(3)] for k, v in model.items() if k not in TABLES}
    slots = {k: [np.zeros(model[k].shape), np.zeros(n), np.zeros(n)] for k, n in TABLES.items()}
    n = 0
    for piece in pieces:
        t, dense, met = pickle.loads(piece)
        n, moments["t"] = n + 1, max(moments["t"], t)
        for k, made in dense.items():
            for total, one in zip(sums[k], made, strict=True):
                total += one
        for k, (at, made, moved) in met.items():
            slots[k][0][at] += made
            slots[k][1][at] += moved
            slots[k][2][at] += 1
    for k, made in sums.items():
        for kept, total in zip((model[k], *moments[k]), made, strict=True):
            kept += (total / max(n, 1)).astype(np.float32)
    for k, (made, moved, met) in slots.items():
        model[k] += (made / np.maximum(met, 1)[:, None]).astype(np.float32)
        moments[k] += (moved / np.maximum(met, 1)).astype(np.float32)


def odds(rows: DataFrame) -> dict:
    """``slot_counts`` of all ``rows`` (text, toxic), counted in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((2, n), np.int64) for k, n in TABLES.items()}
        for part, _, _ in tn.chunks(batches):
            toxic = part.column(part.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False).astype(bool)
            for k, found in slot_counts(part.column(part.schema.get_field_index("text")), toxic).items():
                sums[k] += found
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sums)], pa.binary())], ["found"])

    sums = {k: np.zeros((2, n), np.int64) for k, n in TABLES.items()}
    for r in stash(rows.select("text", "toxic").mapInArrow(run, "found binary"), "odds").toLocalIterator():
        for k, found in pickle.loads(r.found).items():
            sums[k] += found
    return sums


def turns_of(n: int) -> int:
    """In how many of the turns each of ``n`` rows takes part."""
    return max(1, min(ROUNDS, ROUNDS * PIECE_ROWS // max(n, 1)))


def in_turn(rows: DataFrame, turn: int, n: int) -> DataFrame:
    """The rows (of ``n``) that take part in a turn, with their piece of it."""
    each = turns_of(n)
    pieces = max(1, round(n * each / ROUNDS / PIECE_ROWS))
    place = F.pmod(F.xxhash64("doc_id", F.lit("turn")), F.lit(ROUNDS << 32))
    mine = F.pmod(place - turn, F.lit(ROUNDS)) < each
    return rows.filter(mine).withColumn("piece", F.pmod(F.floor(place / ROUNDS), F.lit(pieces))).repartition(2 * pieces, "piece")


def _work(sent: Broadcast, turn: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        made, moved = copy.deepcopy(sent.value)
        rng = np.random.default_rng([seed, turn, table.column("piece")[0].as_py()])
        train_piece(made, moved, table.column("text").to_pylist(), table.column("toxic").to_numpy().astype(bool), turn, rng)
        return pa.table({"found": pa.array([changes(sent.value, (made, moved))], pa.binary())})

    return run


def train(rows: DataFrame, toxic: int, clean: int, seed: int = SEED) -> dict | None:
    """A model whose decision line is still at even odds, from all ``rows`` (doc_id, text,
    toxic), so many of each class; None where one of the classes has no row."""
    if not (toxic and clean):
        return None
    spark = rows.sparkSession
    ship(spark)
    model = fresh_model(np.random.default_rng(seed))
    moments = fresh_moments(model)
    set_odds(model, odds(rows), toxic, clean)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model, moments))
        found = in_turn(rows, turn, toxic + clean).groupBy("piece").applyInArrow(_work(sent, turn, seed), "found binary")
        average(model, moments, (r.found for r in stash(found, "turn").toLocalIterator()))
        sent.destroy()
    return model | {"line": 0.0}


def quantile(values: np.ndarray, count: np.ndarray, share: float) -> float:
    """``np.quantile`` of values that stand for so many equal ones each."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(count[order])
    place = share * (upto[-1] - 1)
    low, high = values[order][np.searchsorted(upto, [np.floor(place), np.ceil(place)], "right")]
    return float(low + (place - np.floor(place)) * (high - low))


def decision_line(best: np.ndarray, toxic: np.ndarray, rows: tuple[float, float] = (1.0, 1.0), count: np.ndarray | None = None) -> float:
    """Between the upper end of clean and the lower end of toxic logits; where they overlap,
    the line with the best F1, a clean and a toxic logit standing for so many ``rows``. A
    logit occurs ``count`` times. Even odds where a class has no logit."""
    if not 0 < toxic.sum() < len(toxic):
        return 0.0
    count = np.ones(len(best), np.int64) if count is None else count
    clean_top, toxic_low = quantile(best[~toxic], count[~toxic], 0.998), quantile(best[toxic], count[toxic], 0.05)
    if toxic_low > clean_top:
        return float(clean_top + 0.5 * (toxic_low - clean_top))
    by = np.argsort(-best, kind="stable")
    order, hits, misses = best[by], np.cumsum((toxic * count)[by]) * rows[1], np.cumsum((~toxic * count)[by]) * rows[0]
    f1 = np.where(np.append(order[1:] != order[:-1], True), 2 * hits / (hits + misses + hits[-1]), -1)
    at = int(np.argmax(f1))
    return float((order[at] + order[min(at + 1, len(order) - 1)]) / 2)


def scores(model: dict | None, texts: pa.Array, known: dict | None = None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    return sigmoid(row_logits(model, texts, known).astype(np.float64) - model["line"] + np.log(LINE / (1 - LINE)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, text and aside (kept from training) of all labelled documents that are
    not held out, a row for each id. The ids go to the documents in blocks of
    ``SENT_BYTES``, so only labelled texts are moved."""
    known = stash(labels.filter("toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic") > 0).alias("toxic")), "known")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = [texts.join(F.broadcast(block), "doc_id") for block in in_blocks(known, SENT_BYTES)]
    rows = reduce(DataFrame.unionByName, found).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return rows.withColumn("aside", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Train on one part of all labelled rows, and set the decision line on the other."""
    with scratch(docs.sparkSession):
        rows = stash(labelled_rows(docs, labels), "labelled")
        totals = {r.toxic: r["count"] for r in rows.filter("not aside").groupBy("toxic").count().collect()}
        model = train(rows.filter("not aside"), totals.get(True, 0), totals.get(False, 0))
        if model is None:
            return None
        logits = score_rows(rows.filter("aside").select("toxic", "text").repartition(64), model, raw=True)
        # at most so many rows as there are steps between the least and the largest logit
        found = logits.groupBy("toxic", F.round(F.col("__score") * FINE).alias("at")).count().orderBy("at", "toxic").toPandas()
        # as in training, empty texts count as clean
        blank = row_logits(model, pa.array([""]))
        best, toxic, count = np.append(found["at"].to_numpy(float) / FINE, blank), np.append(found["toxic"].to_numpy(dtype=bool), False), np.append(found["count"].to_numpy(), EMPTY)
        model["line"] = decision_line(best, toxic, count=count)
        return model


def score_rows(docs: DataFrame, model: dict | None, raw: bool = False) -> DataFrame:
    """``docs`` with a score column (``raw``: logits), read from the text alone."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for rows, _, _ in tn.chunks(batches, text):
            found = (row_logits if raw else scores)(shared.value, rows.column(rows.schema.get_field_index(text)), known)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.float64())], [*rows.schema.names, "score"])

    schema = StructType([*numbered.schema.fields]).add("score", DoubleType())
    scored = numbered.mapInArrow(run, schema)
    return scored.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("score").alias("__score"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Empty and null texts have one empty window and so a score. Without labelled rows of
    both classes to train on every score is 0. Labels whose id no document has are not used; rows
    that repeat are scored alike; other columns are not read.
    """
    scored = score_rows(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= LINE).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the line, with all their columns."""
    scored = score_rows(docs, fit(docs, labels))
    return scored.filter(F.col("__score") < LINE).drop("__score")
