"""Language-model scoring: a causal self-attention model in numpy over public subword ids.

Model.  A token's embedding comes from the words that follow it.  Attention over the
window so far (content scores plus a learned weight for each distance) is added to the
token itself and gives the next token's class; classes gather tokens with like left
neighbours, and a class's tokens have the shares that the whole training corpus gives
them after the token before (a column for each of the most frequent ones, the others
dealt over some more columns), drawn to their shares in the class.  Texts are scored in overlapping windows, each token once, with batched masked
attention; the end of a text is a token.

Fitting.  Subword counts cover all training texts, and so do the counts of each token's
left and right neighbours, from which embeddings, classes and shares come.  All windows
of all training texts train the weights: the driver takes the first steps, on at most
``most_windows`` windows; then, in a few rounds over as many parts of the texts, every
partition takes gradient steps over all windows of its texts from the same weights, which
are averaged in Spark.

Base score.  Word counts are exact.  A bounded list of words that are frequent in a
sample is counted by hash aggregates and comes back as one array; all other words meet
their count by a shuffle on the word, which has no frequent ones left.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .numbering import numbered
from .quality import is_held_out
from .store import bounded_batches, drop, holding, kept, some_rows

VOCABULARY, END, PAD = 50257, 50256, 65535
WIDTH, CLASSES = 32, 64
#: Columns of neighbours, and how many of them are for one token each.
CONTEXT, SINGLE = 256, 192
WINDOW, STRIDE = 32, 24
#: Windows in a step of training in Spark, and how many are mixed at a time.
BATCH, MIXED = 128, 1 << 15
#: Windows whose slopes, or scores, are computed at a time.  A sum of exp of scores below HIGH has no score above 80; one above LOW has lost nothing.
BLOCK, SCORED, LOW, HIGH = 32, 64, 1e-30, 5e34
LONG = 1000
#: Blanks as the subword pattern has them: \s of ``re`` has \x1c-\x1f besides.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Whole words and, as group 1, whole gaps of over LONG code points.
_LONG_RUNS = re.compile(rf"(?<![^{_BLANK}])[^{_BLANK}]{{{LONG + 1},}}|(?<![{_BLANK}])([{_BLANK}]{{{LONG + 1},}})")
#: Two blanks side by side.
_GAPS = re.compile(f"[{_BLANK}][{_BLANK}]")
_encoders: dict[int, object] = {}


#: Fixed value: how the vocabulary's texts are cut before pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GAPS = r"\s+(?!\S)|\s+"


def tokenizer_file() -> str:
    """The installed public byte-level BPE ranks, where no file is named."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(ranks: bytes, pattern: str):
    """A tiktoken encoding of the ranks' file content, made once in each process."""
    key = hash((ranks, pattern))
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def subwords(text: str, encode, has_long: bool = True) -> np.ndarray:
    """Subword ids of a whole text; where it has words or gaps of over 1000 code points, they are encoded in pieces, and all the rest as ever."""
    if not has_long:
        return encode(text)
    cuts = [0]
    for run in _LONG_RUNS.finditer(text):
        a, b = run.span()
        # the pattern leaves a gap's last blank to the word behind it: cuts before that blank change no id around the run
        if run[1] is None:
            cuts += [max(a - 1, 0), *range(a + LONG, b, LONG), b]
        else:
            end = b - (b < len(text))
            cuts += [*range(a, end, LONG), end]
    cuts.append(len(text))
    return np.concatenate([np.zeros(0, np.uint32), *(np.asarray(encode(text[a:b])) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)])


def encoders(ranks: bytes, pattern: str):
    """Texts to ids: any texts, and those without two blanks side by side.  There the look-ahead at what follows a gap decides nothing, and a pattern without it cuts faster."""
    return tuple(partial(encoder(ranks, p).encode_to_numpy, disallowed_special=()) for p in (pattern, pattern.replace(GAPS, r"\s+")))


def has_long_runs(start: np.ndarray, end: np.ndarray, first: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which texts have a word, or a gap between words, of LONG bytes or more."""
    n = len(texts)
    out = np.array([len(t) for t in texts]) >= LONG
    if not len(start):
        return out
    bounds = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    of = np.repeat(np.arange(n), np.diff(first))
    before = np.maximum(np.r_[0, end[:-1]], bounds[of])
    long = (end - start >= LONG) | (start - before >= LONG)
    some = np.bincount(of, long, n) > 0
    has_words = np.diff(first) > 0
    last_end = np.where(has_words, end[np.maximum(first[1:] - 1, 0)], bounds[:-1])
    return out & (some | (bounds[1:] - 1 - last_end >= LONG))


@dataclass
class Model:
    """embed (V, d); classes (V,); column (V,) of the token before; share (V, columns): ln of a token's share in its class by that column; weights: one flat vector."""

    embed: np.ndarray
    classes: np.ndarray
    column: np.ndarray
    share: np.ndarray
    weights: np.ndarray

    def parts(self, flat: np.ndarray | None = None):
        d, c = WIDTH, CLASSES
        flat = self.weights if flat is None else flat
        out, at = [], 0
        for shape in ((d, d), (d, d), (d, c), (d, c), (c,), (WINDOW,)):
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape))
            at += n
        return out

    @staticmethod
    def size() -> int:
        return 2 * WIDTH * WIDTH + 2 * WIDTH * CLASSES + CLASSES + WINDOW

    def slope(self, ids: np.ndarray, flat: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss over windows ids (n, t + 1), whose last column is a target only, and its gradient; PAD, which may end a window, is no target."""
        slopes = Slopes(self.embed, self.classes, *np.subtract(ids.shape, (0, 1)))
        return slopes(*slopes.read(ids), flat, True)

    def steps(self, windows: np.ndarray, flat: np.ndarray, rate: float, batch: int = 64, seed: int = 3) -> np.ndarray:
        """Adam over the windows once."""
        adam = Adam(self.embed, self.classes, flat, rate, batch, seed)
        adam.pass_over(windows)
        return adam.flat

    def scores(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each id sequence with its end; its start follows an end."""
        a, b, c1, c2, bias, far = self.parts()
        embedded, asking, direct = self._tables(a, c1, bias)
        brought = b @ c2  # what attention brings goes to the classes at once
        near = np.tril(np.exp(_distances(far, WINDOW)))  # true zeros ahead, as in training
        n = [len(s) + 1 for s in sequences]  # tokens to score
        flat = np.full(sum(n) + len(n) + WINDOW, END, np.int64)
        begin = np.r_[0, np.cumsum(np.array(n) + 1)][:-1].astype(np.int64)
        for s, at in zip(sequences, begin, strict=True):
            flat[at + 1 : at + 1 + len(s)] = s
        many = 1 + np.maximum(0, -(-(np.array(n) - WINDOW) // STRIDE))
        doc = np.repeat(np.arange(len(n)), many)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        place = begin[doc] + turn * STRIDE
        left = np.array(n)[doc] - turn * STRIDE  # tokens from the window's start to the text's end
        skip = np.where(turn > 0, WINDOW - STRIDE, 0)
        out = np.zeros(len(n))
        col = np.arange(WINDOW)
        ones = np.ones(max(CLASSES, WINDOW), np.float32)
        share = self.share.ravel()
        # windows inside a text score the same columns and need no mask; its first and last ones do
        inner = (turn > 0) & (left >= WINDOW)
        for masked, chosen in ((False, np.flatnonzero(inner)), (True, np.flatnonzero(~inner))):
            new = 0 if masked else WINDOW - STRIDE  # the first column that any of these windows scores
            most, t = min(SCORED, len(chosen)), WINDOW - new
            arrays = [np.empty(shape, np.float32) for shape in ((most, WINDOW, WIDTH), (most, t, WIDTH), (most, WIDTH, WINDOW), (most, t, WINDOW), (most, t, WIDTH), (most, t, CLASSES), (most, t, CLASSES))]
            for k in range(0, len(chosen), SCORED):
                own = chosen[k : k + SCORED]
                rows, asked, across, p, h, z, own_part = (x[: len(own)] for x in arrays)
                at = place[own, None] + col
                ids = flat[np.minimum(at, len(flat) - 2)]
                before = ids[:, new:]
                target = flat[np.minimum(at[:, new:] + 1, len(flat) - 1)]
                embedded.take(ids, 0, out=rows, mode="clip")
                asking.take(before, 0, out=asked, mode="clip")
                np.copyto(across, rows.transpose(0, 2, 1))
                np.matmul(asked, across, out=p)
                np.exp(p, out=p)
                p *= near[new:]
                np.matmul(p, rows, out=h)
                h *= (1 / np.matmul(p.reshape(-1, WINDOW), ones[:WINDOW])).reshape(-1, t, 1)
                np.matmul(h.reshape(-1, WIDTH), brought, out=z.reshape(-1, CLASSES))
                z += direct.take(before, 0, out=own_part, mode="clip")
                hit = z.ravel()[np.arange(before.size) * CLASSES + self.classes.take(target).ravel()].reshape(before.shape)
                np.exp(z, out=z)
                value = hit - np.log(np.matmul(z.reshape(-1, CLASSES), ones[:CLASSES])).reshape(before.shape) + share.take(target * CONTEXT + self.column.take(before))
                if masked:
                    value[(col < skip[own, None]) | (col >= left[own, None])] = 0
                out += np.bincount(doc[own], value.sum(1, dtype=float), len(n))
        return out / np.log(10)

    def _tables(self, a: np.ndarray, c1: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each id: its embedding; what it asks for; its own part of the next class's scores."""
        if not hasattr(self, "_rows"):
            self._rows = tuple(np.ascontiguousarray(x, np.float32) for x in (self.embed, self.embed @ a, self.embed @ c1 + bias))
        return self._rows


class Slopes:
    """Losses and gradients over windows of t tokens, some at a time in arrays that are made once and stay in a core's cache: most of the time would go into moving them."""

    def __init__(self, embed: np.ndarray, classes: np.ndarray, n: int, t: int):
        n = min(n, BLOCK)
        self.classes, self.t, self.n = classes.astype(np.intp), t, n
        self.embed = np.ascontiguousarray(embed, np.float32)
        self.gap = np.maximum(np.arange(t)[:, None] - np.arange(t)[None], 0).ravel()
        self.first = np.arange(n * t) * CLASSES
        self.x_h, self.z = np.empty((n * t, 2 * WIDTH), np.float32), np.empty((n * t, CLASSES), np.float32)
        self.rows = [np.empty((n * t, WIDTH), np.float32) for _ in range(3)]
        self.pairs = [np.empty((n, t, t), np.float32) for _ in range(2)]
        self.across = np.empty((n, WIDTH, t), np.float32)
        self.ones = np.ones(max(n * t, CLASSES), np.float32)

    def read(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of windows (n, t + 1), whose last column is a target only: the token before each target, the target's class, and whether it is one."""
        before, target = ids[:, :-1].ravel(), ids[:, 1:].ravel()
        use = target != PAD
        # no target attends to what is behind it, so any token will do there
        return np.where(before != PAD, before, END).astype(np.intp), self.classes.take(np.where(use, target, END)), use

    def __call__(self, before: np.ndarray, target: np.ndarray, use: np.ndarray, flat: np.ndarray, with_loss: bool = False) -> tuple[float, np.ndarray]:
        """Mean loss, 0 unless asked for, and its gradient over whole windows as ``read`` gives them.  Embeddings are not learned, so what attention brings is taken as it is and meets b @ c2 at once."""
        a, b, c1, c2, bias, far = Model.parts(self, flat)
        near = np.tril(np.exp(_distances(far, self.t)))  # a true zero ahead: tiny numbers take a hundred times as long
        brought = b @ c2
        weights = a, np.concatenate([c1, brought]), brought, bias, near
        many, step = max(1, int(use.sum())), self.n * self.t
        sums = [self._block(before[k : k + step], target[k : k + step], use[k : k + step], many, with_loss, *weights) for k in range(0, len(before), step)]
        loss, by_a, by_class, by_bias, by_pair = (sum(x) for x in zip(*sums, strict=True))
        by_gap = np.zeros(WINDOW)
        by_gap[: self.t] = np.bincount(self.gap, by_pair, self.t)  # nothing is attended ahead: by_pair is zero there
        by_brought = by_class[WIDTH:]
        grads = (by_a, by_brought @ c2.T, by_class[:WIDTH], b.T @ by_brought, by_bias, by_gap)
        return loss / many, np.concatenate([g.ravel() for g in grads]).astype(np.float32)

    def _block(self, before, target, use, many, with_loss, a, c, brought, bias, near):
        """Sums of losses over windows, and of gradients by a, by the classes' weights, by their bias and by pairs of places."""
        t, d, rows = self.t, WIDTH, len(before)
        n = rows // t
        x_h, z = self.x_h[:rows], self.z[:rows]
        x, asking, dh = (r[:rows] for r in self.rows)
        p, dp, across = (r[:n] for r in (*self.pairs, self.across))
        by_window = lambda r: r.reshape(n, t, -1)
        # forward: attention, what it brings, scores of classes
        self.embed.take(before, 0, out=x, mode="clip")
        np.copyto(across, by_window(x).transpose(0, 2, 1))
        np.matmul(x, a, out=asking)
        np.matmul(by_window(asking), across, out=p)
        np.exp(p, out=p)
        p *= near
        p *= (1 / np.matmul(p.reshape(-1, t), self.ones[:t])).reshape(n, t, 1)
        x_h[:, :d] = x
        np.matmul(p, by_window(x), out=by_window(x_h)[..., d:])
        np.matmul(x_h, c, out=z)
        hit = self.first[:rows] + target
        loss = -float((z.ravel()[hit] + bias[target])[use].clip(None, 80).sum()) if with_loss else 0.0
        # a class's exp of bias multiplies sums, so that z needs no more than one exp
        np.exp(z, out=z)
        times = np.exp(bias)
        total = np.matmul(z, times)
        if not (total.min() > LOW and total.max() < HIGH):  # scores end at 80
            np.matmul(x_h, c, out=z)
            z += bias
            np.minimum(z, 80, out=z)
            np.exp(z, out=z)
            times = self.ones[:CLASSES]
            total = np.matmul(z, times)
        if with_loss:
            loss += float(np.log(total)[use].sum())
        # backward; z becomes the slope by the scores of classes, over ``times``
        use = use / np.float32(many)
        z *= (use / total)[:, None]
        z.ravel()[hit] -= use / times[target]
        np.matmul(z, (brought * times).T, out=dh)
        np.matmul(by_window(dh), across, out=dp)
        dp -= np.vecdot(dh, x_h[:, d:]).reshape(n, t, 1)
        dp *= p
        back = asking
        np.matmul(dp, by_window(x), out=by_window(back))
        return loss, np.matmul(x.T, back), np.matmul(x_h.T, z) * times, np.matmul(self.ones[:rows], z) * times, np.matmul(self.ones[:n], dp.reshape(n, -1))


class Adam:
    """Steps of Adam from given weights, over windows (n, WINDOW + 1) as they come."""

    def __init__(self, embed: np.ndarray, classes: np.ndarray, flat: np.ndarray, rate: float, batch: int = 64, seed: int = 3):
        self.slopes, self.flat, self.rate, self.batch = Slopes(embed, classes, batch, WINDOW), flat.copy(), rate, batch
        self.m, self.s, self.k = np.zeros_like(flat), np.zeros_like(flat), 0
        self.rng = np.random.default_rng(seed)

    def pass_over(self, windows: np.ndarray) -> None:
        """A step for each batch of the windows, in random order."""
        read = self.slopes.read(windows[self.rng.permutation(len(windows))])
        step = self.batch * WINDOW
        for at in range(0, len(windows) * WINDOW, step):
            _, g = self.slopes(*(x[at : at + step] for x in read), self.flat)
            self.k += 1
            self.m = 0.9 * self.m + 0.1 * g
            self.s = 0.99 * self.s + 0.01 * g * g
            self.flat -= self.rate * (self.m / (1 - 0.9**self.k)) / (np.sqrt(self.s / (1 - 0.99**self.k)) + 1e-7)


def _distances(far: np.ndarray, t: int) -> np.ndarray:
    """Scores by distance for t places, -inf (a large negative number) ahead."""
    gap = np.arange(t)[:, None] - np.arange(t)[None]
    return np.where(gap >= 0, far[np.maximum(gap, 0)], np.float32(-80)).astype(np.float32)


def _columns(counts: np.ndarray) -> np.ndarray:
    """Of each id its column of neighbour counts: the SINGLE most frequent ids have one each, the others are dealt over the rest."""
    column = (SINGLE + np.arange(VOCABULARY) * 40503 % 65521 % (CONTEXT - SINGLE)).astype(np.uint8)
    column[np.argsort(-counts.astype(float), kind="stable")[:SINGLE]] = np.arange(SINGLE)
    return column


def _factor(m: np.ndarray, total: np.ndarray) -> np.ndarray:
    """(V, WIDTH) embedding of tokens by how often each has its neighbours in each column (V, CONTEXT)."""
    by_column, rows = m.sum(0, keepdims=True, dtype=float), m.sum(1, keepdims=True)
    expected = (by_column / max(1.0, float(by_column.sum()))).astype(np.float32)
    m = np.sqrt(m + 2 * expected) / np.sqrt(rows + 2) - np.sqrt(expected)
    weight = np.minimum(total, 1000).astype(np.float32)[:, None]
    _, vectors = np.linalg.eigh((m * weight).T @ m)
    out = m @ vectors[:, ::-1][:, :WIDTH]
    scale = np.sqrt((out**2 * weight).sum(0) / max(1.0, float(weight.sum()))) + 1e-6
    return (out / scale).clip(-4, 4).astype(np.float32)


def _shares(preceding: np.ndarray, total: np.ndarray, classes: np.ndarray, pull: float = 4.0) -> np.ndarray:
    """(V, CONTEXT): ln of each token's share in its class after a token of each column; ``pull`` tokens with the shares in the class are added to what was counted."""
    share = (total + 1) / np.bincount(classes, total + 1, CLASSES)[classes]
    inside = np.stack([np.bincount(classes, preceding[:, j], CLASSES) for j in range(CONTEXT)], 1)
    out = preceding + (pull * share[:, None]).astype(np.float32)
    out /= (inside + pull).astype(np.float32)[classes]
    return np.log(out, out=out)


def fit(windows: np.ndarray, counts: np.ndarray, following: np.ndarray, preceding: np.ndarray, rate: float = 0.01) -> Model:
    """Embeddings and classes from neighbour counts (V, CONTEXT), weights warmed up on windows (n, WINDOW + 1); ``counts``: of each id.  All counts are of all training texts."""
    ids = windows.astype(np.int64).reshape(-1, WINDOW + 1)
    total = counts.astype(float)
    embed = _factor(following, total)
    company = _factor(preceding, total)
    # k-means of tokens by their left company, each weighing as often as it occurs
    rng = np.random.default_rng(1)
    weight = total + 1e-3
    centre = company[rng.choice(VOCABULARY, CLASSES, replace=False, p=np.minimum(weight, 5000) / np.minimum(weight, 5000).sum())]
    for _ in range(8):
        near = (company @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
        mass = np.bincount(near, weight, CLASSES)
        for j in range(WIDTH):
            centre[:, j] = np.bincount(near, weight * company[:, j], CLASSES) / np.maximum(mass, 1e-9)
    model = Model(embed, near, _columns(counts), _shares(preceding, total, near), np.zeros(Model.size(), np.float32))
    flat = (np.random.default_rng(2).standard_normal(Model.size()) * 0.05).astype(np.float32)
    mass = np.bincount(near, total + 1, CLASSES)
    model.parts(flat)[4][:] = np.log((mass + 1e-3) / mass.sum())
    model.parts(flat)[5][:] = -0.15 * np.arange(WINDOW)
    if len(ids):
        for k in range(2):
            flat = model.steps(ids, flat, rate / (1 + 2 * k), seed=k)
    model.weights = flat
    return model


_READ = "u long, id long, held_out boolean, ids binary, n_words long, known binary, known_n binary, rare array<long>, rare_n array<int>"


def _read(ranks, frequent):
    """Tokens of each text: subword ids, frequent words by their index and the others by their hash, with their counts."""

    def run(batches):
        data, pattern = ranks.value
        encode, encode_single = encoders(data, pattern)
        table = frequent.value
        for batch in batches:
            for row, texts in W.chunks(batch.column("text")):
                h, start, end, first, _ = W.words(texts)
                long = has_long_runs(start, end, first, texts)
                of = np.repeat(np.arange(len(texts)), np.diff(first))
                # equal words of a text side by side by one sort of one key, then texts in order
                key = W.mix(h + of.astype(np.uint64) * W._SHINGLE[0])
                order = np.argsort(key)
                key = key[order]
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(h) else np.empty(0, np.int64)
                many = np.diff(np.r_[new, len(h)]).astype(np.int32)
                h, of = h[order[new]], of[order[new]]
                by_text = np.argsort(of.astype(np.min_scalar_type(len(texts))), kind="stable")
                h, of, many = h[by_text], of[by_text], many[by_text]
                at, by_hash = np.empty(len(h), np.int64), np.argsort(h)  # neighbours in the table one after another
                at[by_hash] = np.minimum(np.searchsorted(table, h[by_hash]), max(len(table) - 1, 0))
                is_known = table[at] == h if len(table) else np.zeros(len(h), bool)
                ends = lambda part: np.r_[0, np.cumsum(np.bincount(of[part], minlength=len(texts)))].astype(np.int32)  # noqa: E731, B023
                # the frequent words are read by workers only, which take bytes at a fraction of the time of arrays
                offsets = pa.py_buffer(ends(is_known) * np.int32(4))
                lists = [pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, pa.py_buffer(x[is_known])]) for x in (at.astype(np.int32), many)]
                offsets = ends(~is_known)
                lists += [pa.ListArray.from_arrays(offsets, x[~is_known]) for x in (h.view(np.int64), many)]
                lower = [t.translate(W.LOWER).decode("utf-8", "replace") for t in texts]
                ids = [subwords(t, encode if x or _GAPS.search(t) else encode_single, x).astype(np.uint16).tobytes() for t, x in zip(lower, long, strict=True)]
                own = batch.slice(row, len(texts))
                yield pa.RecordBatch.from_arrays([own.column("u"), own.column("id"), own.column("held_out"), pa.array(ids, pa.binary()), pa.array(np.diff(first)), *lists], [x.split()[0] for x in _READ.split(", ")])

    return run


def _frequent(most: int):
    def run(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for _, texts in W.chunks(batch.column("text")):
                for x, n in zip(*(v.tolist() for v in np.unique(W.words(texts)[0], return_counts=True)), strict=True):
                    total[x] = total.get(x, 0) + n
        top = sorted(total.items(), key=lambda p: (-p[1], p[0]))[:most]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([p[0] for p in top], np.uint64).view(np.int64)), pa.array([p[1] for p in top], pa.int64())], ["word", "n"])

    return run


def _id_counts(batches):
    total = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.uint16), minlength=VOCABULARY)
        total[END] += batch.num_rows
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "n"])


def _pair_counts(columns):
    """How often ids have a next (first half of the pairs) and a previous neighbour in each column; the end stands before and after each text."""

    def run(batches):
        column = columns.value
        following, preceding = np.zeros(VOCABULARY * CONTEXT, np.uint32), np.zeros(VOCABULARY * CONTEXT, np.uint32)
        end = np.full(1, END, np.uint16)
        for batch in batches:
            flat = [end]
            for x in batch.column("ids"):
                flat += [np.frombuffer(x.as_py(), np.uint16), end]
            s = np.concatenate(flat).astype(np.int64)
            np.add.at(following, s[:-1] * CONTEXT + column[s[1:]], np.uint32(1))
            np.add.at(preceding, s[1:] * CONTEXT + column[s[:-1]], np.uint32(1))
        for half, total in enumerate((following, preceding)):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at + half * len(total)), pa.array(total[at].astype(np.int64))], ["pair", "n"])

    return run


def _packed(batches):
    """A partition's pairs and their counts as one row of two arrays' bytes."""
    held = [(batch.column("pair").to_numpy(), batch.column("n").to_numpy()) for batch in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*held, strict=True)], ["pairs", "n"])


def _neighbours(training: DataFrame, counts: np.ndarray) -> np.ndarray:
    """(2, V, CONTEXT): of each id in all training texts, its next and its previous neighbours by column."""
    columns = training.sparkSession.sparkContext.broadcast(_columns(counts))
    summed = training.select("ids").mapInArrow(_pair_counts(columns), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(2 * VOCABULARY * CONTEXT, np.float32)
    for r in summed.mapInArrow(_packed, "pairs binary, n binary").toLocalIterator():  # a partition at a time, at most as many pairs as ``out`` has
        out[np.frombuffer(r["pairs"], np.int64)] = np.frombuffer(r["n"], np.int64)
    return out.reshape(2, VOCABULARY, CONTEXT)


def _numbers(column: pa.Array) -> np.ndarray:
    """The 32-bit numbers that a column's rows hold as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32)


def _word_counts(size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column("known")), _numbers(batch.column("known_n")), size).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "n"])

    return run


def _cut(data: bytes) -> np.ndarray:
    """Windows (n, WINDOW + 1) of a text's ids with an end before and after them; the last one is padded, and each starts with the last id of the one before."""
    n = len(data) // 2 // WINDOW + 1
    s = np.full(n * WINDOW + 1, PAD, np.uint16)
    s[0] = END
    s[1 : len(data) // 2 + 1] = np.frombuffer(data, np.uint16)
    s[len(data) // 2 + 1] = END
    return np.lib.stride_tricks.sliding_window_view(s, WINDOW + 1)[::WINDOW]


def _marks(texts: list[bytes], many: list[int]) -> np.ndarray:
    """Hashes of texts' windows one after another, by the text's ids and the window's place."""
    heads = np.frombuffer(b"".join(x[:64].ljust(64, b"\0") for x in texts), np.uint64).reshape(-1, 8)
    seed = np.array([len(x) for x in texts], np.uint64) + (heads * W._SHINGLE[:8]).sum(1)
    many = np.array(many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return W.mix(place.astype(np.uint64) + np.repeat(seed, many))


def _windows(every: int):
    """One in ``every`` windows of each text, by its hash."""

    def run(batches):
        for batch in batches:
            texts = batch.column("ids").to_pylist()
            many = [len(x) // 2 // WINDOW + 1 for x in texts]
            mark = _marks(texts, many)
            chosen = np.flatnonzero(mark % np.uint64(every) == 0)
            first = np.cumsum(many) - many
            of = np.searchsorted(first, chosen, "right") - 1
            out = [_cut(texts[i])[k].tobytes() for i, k in zip(of.tolist(), (chosen - first[of]).tolist(), strict=True)]
            key = (mark[chosen] >> np.uint64(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(key, pa.int64())], ["window", "key"])

    return run


def _trained(shared, flat: np.ndarray, rate: float, every: int = 1):
    """Steps over all windows of a partition's texts (or one in ``every``), mixed some ten thousand at a time: the weights, times how many windows there were."""

    def run(batches):
        adam = Adam(*shared.value, flat, rate, BATCH)
        many, waiting, held = 0, 0, []

        def step():
            nonlocal many, waiting
            adam.pass_over(np.concatenate(held))
            many, waiting = many + waiting, 0
            held.clear()

        for batch in batches:
            for x in batch.column("ids"):
                data = x.as_py()
                windows = _cut(data)
                held.append(windows if every == 1 else windows[_marks([data], [len(windows)]) % np.uint64(every) == 0])
                waiting += len(held[-1])
                if waiting >= MIXED:
                    step()
        if waiting:
            step()
        if many:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(adam.flat.astype(float) * many), pa.array(np.full(len(flat), many))], ["place", "value", "n"])

    return run


def _scored(shared, logs):
    """(u, id, held_out, n_words, score, sum of ln of the frequent words, frequent words known)."""

    def run(batches):
        model, log_known, is_known = shared.value, logs.value, logs.value > 0
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column("ids")]
            score = np.zeros(len(ids))
            k = 0
            while k < len(ids):  # some hundred thousand tokens at a time
                j, total = k, 0
                while j < len(ids) and (j == k or total < 200_000):
                    total += len(ids[j])
                    j += 1
                score[k:j] = model.scores(ids[k:j])
                k = j
            at, n = (_numbers(batch.column(c)) for c in ("known", "known_n"))
            of = np.repeat(np.arange(len(ids)), [len(x.as_py()) // 4 for x in batch.column("known")])
            sums = np.bincount(of, log_known[at] * n, len(ids)) if len(at) else np.zeros(len(ids))
            hits = np.bincount(of, is_known[at] * n, len(ids)).astype(np.int64) if len(at) else np.zeros(len(ids), np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u", "id", "held_out", "n_words")), pa.array(score), pa.array(sums), pa.array(hits)], ["u", "id", "held_out", "n_words", "score", "sums", "hits"])

    return run


def _as_array(rows, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r in rows.toLocalIterator():  # at most ``size`` rows
        out[r["token"]] = r["n"]
    return out


def _most_frequent(counted: DataFrame, most: int, top: int = 100_000) -> list[int]:
    """The words with the highest counts, at most ``most``: those above the lowest count that fits, from a histogram of counts."""
    left = most
    least = top
    for r in counted.select(F.least("n", F.lit(top)).alias("n")).groupBy("n").count().orderBy(F.desc("n")).collect():  # at most ``top`` rows
        if r["count"] > left:
            break
        left -= r["count"]
        least = r["n"]
    else:
        least = 0
    return [r["word"] for r in counted.where(F.col("n") >= least).collect()] if left < most else []


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, modulus: int = 7, remainder: int = 2, frequent_words: int = 1 << 18, sample_share: int = 16, most_windows: int = 12_000, every: int = 1, rounds: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows with crc32(id as text) mod ``modulus`` = ``remainder`` are held out; all others,
    null ids too, are learned from.  Null texts are empty: one end token.  Repeated rows
    are learned from and scored each; other columns are ignored.  ``tokenizer``: a file of
    50,256 byte-level BPE ranks.  ``frequent_words``
    bounds the broadcast words, chosen on one in ``sample_share`` texts (which ones are
    chosen changes no result).  Embeddings, classes and shares come from counts over all
    training texts.  Texts of any length are read, learned from and scored whole.  All
    their windows train the weights, once each, in ``rounds`` rounds; ``most_windows`` bounds
    those that the driver takes the first steps on.  ``every`` above 1 trains on one window
    in so many only.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 500)
    context = spark.sparkContext
    rows = numbered(docs, id_col, text_col).withColumn("held_out", is_held_out(F.col("id"), modulus, remainder))
    sample = rows.where(F.pmod(F.xxhash64("u"), F.lit(sample_share)) == 0).select("text").mapInArrow(_frequent(frequent_words), "word long, n long")
    counted = kept(sample.groupBy("word").agg(F.sum("n").alias("n")), "sample")
    table = np.sort(np.array(_most_frequent(counted, frequent_words), np.int64).view(np.uint64))
    drop(counted)
    with open(tokenizer or tokenizer_file(), "rb") as f:
        ranks = context.broadcast((f.read(), PATTERN))
    read = kept(rows.mapInArrow(_read(ranks, context.broadcast(table)), _READ), "tokens")
    training = read.where(~F.col("held_out"))

    id_counts = _as_array(training.select("ids").mapInArrow(_id_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), VOCABULARY)
    total = training.agg(F.coalesce(F.sum(F.floor(F.octet_length("ids") / (2 * WINDOW)) + 1), F.lit(0))).first()[0]
    windows = kept(training.select("ids").mapInArrow(_windows(max(every, -(-total // max(1, most_windows)))), "window binary, key long"), "windows")
    # copies of a text have windows of one key: a row's number sets them apart
    some = sorted((r["key"], r["window"]) for r in some_rows(windows.withColumn("row", F.monotonically_increasing_id()), F.xxhash64("window", "key", "row"), most_windows))
    drop(windows)
    model = fit(np.array([np.frombuffer(x, np.uint16) for _, x in some]), id_counts, *_neighbours(training, id_counts))
    learned = context.broadcast((model.embed, model.classes))
    for k in range(rounds):
        part = training.where(F.pmod(F.xxhash64("u"), F.lit(rounds)) == k).select("ids")
        steps = part.mapInArrow(_trained(learned, model.weights, 0.002 / (k + 1), every), "place long, value double, n long")
        mean = steps.groupBy("place").agg((F.sum("value") / F.sum("n")).alias("w")).orderBy("place").collect()
        if mean:
            model = Model(model.embed, model.classes, model.column, model.share, np.array([r["w"] for r in mean], np.float32))

    known = _as_array(training.select("known", "known_n").mapInArrow(_word_counts(len(table)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), len(table))
    totals = training.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    ends, train_tokens = totals[0], totals[0] + totals[1]
    rare = read.select("u", "held_out", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("u", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"), F.when(F.col("held_out"), 0).otherwise(F.col("r.rare_n")).alias("t"))
    rare = rare.selectExpr("u", "n", "sum(t) over (partition by word) as c", "row_number() over (partition by word order by u) = 1 as leads")
    rare = rare.selectExpr("u", "n * log10(c + 1) as sums", "if(c > 0, n, 0) as hits", "if(leads and c > 0, 1, 0) as words")
    rare = kept(rare.groupBy("u").agg(F.sum("sums").alias("rare_sums"), F.sum("hits").alias("rare_hits"), F.sum("words").alias("rare_words")), "rare")
    distinct = (rare.agg(F.coalesce(F.sum("rare_words"), F.lit(0))).first()[0]) + int((known > 0).sum()) + (1 if ends else 0)
    logs = context.broadcast(np.log10(known + 1.0) if len(known) else np.zeros(1))
    out = read.select("u", "id", "held_out", "ids", "n_words", "known", "known_n").mapInArrow(_scored(context.broadcast(model), logs), "u long, id long, held_out boolean, n_words long, score double, sums double, hits long")
    out = out.join(rare, "u", "left")
    n_tokens = F.col("n_words") + 1
    sums = F.col("sums") + F.coalesce("rare_sums", F.lit(0.0)) + float(np.log10(ends + 1.0))
    hits = F.col("hits") + F.coalesce("rare_hits", F.lit(0)) + (1 if ends else 0)
    out = out.select(
        F.col("id").alias("doc_id"), "held_out", n_tokens.alias("n_tokens"), hits.cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (sums - n_tokens * float(np.log10(train_tokens + distinct + 1.0))).alias("base_score"), "score",
    )
    return holding(out, read, rare)
