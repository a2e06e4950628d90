"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens (runs of non-space) are tagged O, B or I from their shape, their neighbours and
features of the whole file.  The field is trained by its exact likelihood (forward and
backward sums) on a bounded sample of lines: base matches of the corpus as labels, and
lines into which invented secrets and look-alikes are put.  Viterbi decoding is exact on
whole texts; runs of tokens that no best path can tag are skipped by a bound.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import bounded_batches, drop, kept

# The base patterns, their order and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
_CUES = (b"passw", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"bearer", b"credential", b"private", b"auth", b"key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{24,}", text)]  # runs are maximal either way
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# byte classes of token shapes
_LOWER, _UPPER, _DIGIT, _SIGN, _WIDE = range(5)
_SHAPE = bytes(_WIDE if b >= 0x80 else _DIGIT if 48 <= b <= 57 else _UPPER if 65 <= b <= 90 else _LOWER if 97 <= b <= 122 else _SIGN for b in range(256))
_is = lambda chars: bytes(1 if b in chars else 0 for b in range(256))
_HEX, _PAIR, _AT, _DOT, _SLASH, _DASH = _is(b"0123456789abcdefABCDEF"), _is(b"=:"), _is(b"@"), _is(b"."), _is(b"/"), _is(b"-_")
_LENGTHS = np.array([1, 3, 5, 7, 11, 15, 19, 23, 31, 39, 63])
_SHARES = np.array([1e-9, 0.2, 0.5, 0.9999])
#: Values of each own slot; then the slots repeated for the token before, two before, and after.
SIZES = (12, 5, 5, 5, 5, 8, 25, 16, 16, 16)
BEFORE, BEFORE2, AFTER = (0, 1, 5, 7), (7,), (0, 1, 7)
ALL_SIZES = (*SIZES, *(SIZES[k] + 1 for k in (*BEFORE, *BEFORE2, *AFTER)))


def _cues(low: bytes, words: tuple[bytes, ...]) -> np.ndarray:
    """Start offsets of any of the words."""
    out = []
    for w in words:
        at = low.find(w)
        while at >= 0:
            out.append(at)
            at = low.find(w, at + len(w))
    return np.unique(np.array(out, np.int64))


def tokens(texts: list[bytes]):
    """Token starts, ends and first token of each text in the texts joined by one blank, and the joined bytes."""
    joined = b" ".join(texts) + b" "
    inside = np.frombuffer(b"\0" + joined.translate(W.SPACED), np.int8)
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return starts, ends, np.searchsorted(starts, bounds), joined, bounds


def slots(joined: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Feature values of every token, one array for each slot."""
    n = len(starts)
    length = ends - starts
    shape = np.frombuffer(joined.translate(_SHAPE), np.uint8)

    def total(flags) -> np.ndarray:
        c = np.zeros(len(joined) + 1, np.int32)
        np.cumsum(flags, out=c[1:])
        return c

    def per(table: bytes) -> np.ndarray:
        c = total(np.frombuffer(joined.translate(table), np.uint8))
        return c[ends] - c[starts]

    of = [total(shape == k) for k in range(5)]
    digit, upper, sign, wide, lower = (of[k][ends] - of[k][starts] for k in (_DIGIT, _UPPER, _SIGN, _WIDE, _LOWER))
    change = total(np.r_[False, shape[1:] != shape[:-1]])
    change = change[ends] - change[np.minimum(starts + 1, len(joined))]
    share = lambda x: np.searchsorted(_SHARES, x / length, "left").astype(np.uint8)
    flag = lambda x: (x > 0).astype(np.uint8)
    cue = np.zeros(n, np.uint8)
    at = _cues(joined.lower(), _CUES)
    cue[np.searchsorted(starts, at, "right") - 1] = 1
    pair = per(_PAIR)
    last_pair = np.frombuffer(joined, np.uint8)[ends - 1]
    ends_pair = ((last_pair == 61) | (last_pair == 58)).astype(np.uint8)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    many = np.maximum(np.diff(first), 1)
    file_digits = np.bincount(owner, digit > 0, len(first) - 1) / many
    file_signs = np.bincount(owner, sign > 0, len(first) - 1) / many
    file_slot = np.searchsorted([0.01, 0.05, 0.2], file_digits) * 4 + np.searchsorted([0.1, 0.3, 0.7], file_signs)
    own = [
        np.searchsorted(_LENGTHS, length).astype(np.uint8), share(digit), share(upper), share(sign), share(change),
        (per(_HEX) == length) + 2 * flag((digit > 0) & (lower + upper > 0)) + 4 * flag(wide),
        shape[starts] * 5 + shape[ends - 1],
        cue + 2 * flag(pair) + 4 * ends_pair + 8 * (sign == length).astype(np.uint8),
        flag(per(_AT)) + 2 * flag(per(_DOT)) + 4 * flag(per(_SLASH)) + 8 * flag(per(_DASH)),
        file_slot[owner],
    ]

    def moved(x: np.ndarray, by: int) -> np.ndarray:
        """The value of the token ``by`` places on, plus 1; 0 outside the text."""
        out = np.zeros(n, np.uint8)
        place = np.arange(n) + by
        ok = (place >= first[owner]) & (place < first[owner + 1])
        out[ok] = x[place[ok]] + 1
        return out

    return [x.astype(np.uint8) for x in own] + [moved(own[k], -1) for k in BEFORE] + [moved(own[k], -2) for k in BEFORE2] + [moved(own[k], 1) for k in AFTER]


@dataclass
class Field:
    """Weights: one (values, 3) table for each slot, transitions (3, 3) and start (3,); tags O, B, I."""

    emit: list[np.ndarray]
    move: np.ndarray
    begin: np.ndarray

    def emissions(self, values: list[np.ndarray]) -> np.ndarray:
        out = self.emit[0][values[0]].copy()
        for w, v in zip(self.emit[1:], values[1:], strict=True):
            out += w[v]
        return out

    def viterbi(self, e: np.ndarray, opening: np.ndarray | None = None, closing: np.ndarray | None = None) -> list[int]:
        """Best tags of one run of tokens; opening and closing: scores of the neighbours O outside it."""
        score = e[0] + (self.begin if opening is None else opening)
        back = []
        for t in range(1, len(e)):
            step = score[:, None] + self.move
            back.append(step.argmax(0))
            score = step.max(0) + e[t]
        if closing is not None:
            score = score + closing
        tags = [int(score.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def segments(self, e: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """[start, end) runs of tokens tagged as one secret, of texts one after another."""
        if not len(e):
            return []
        gain = e[:, 1:] - e[:, :1]
        moves = self.move[self.move > -1e6]
        spare = 2 * float(moves.max() - moves.min()) + float(np.abs(self.begin[:2]).max()) + max(0.0, float((gain[:, 1] - gain[:, 0]).max()))
        # a token with less gain than can be lost elsewhere is O on every best path
        active = gain.max(1) > -spare
        edges = np.flatnonzero(np.diff(np.r_[0, active.astype(np.int8), 0]))
        out = []
        starts = set(first.tolist())
        cuts = np.unique(first)  # empty texts begin where the next one does
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            inner = cuts[np.searchsorted(cuts, a, "right") : np.searchsorted(cuts, b, "left")].tolist()
            for x, y in zip([a, *inner], [*inner, b], strict=True):
                opening = self.begin if x in starts else self.move[0]
                closing = None if y in starts or y == len(e) else self.move[:, 0]
                tags = self.viterbi(e[x:y], opening, closing)
                k = 0
                while k < len(tags):
                    if tags[k]:
                        m = k + 1
                        while m < len(tags) and tags[m] == 2:
                            m += 1
                        out.append((x + k, x + m))
                        k = m
                    else:
                        k += 1
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def train(lines: list[bytes], marked: list[list[tuple[int, int]]], steps: int = 80, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Maximum likelihood on lines with secrets at byte spans; AdaGrad, all lines at once.  Without lines: a field that tags nothing."""
    never = np.float32(-1e9)
    field = Field([np.zeros((s, 3), np.float32) for s in ALL_SIZES], np.array([[0, 0, never], [0, 0, 0], [0, 0, 0]], np.float32), np.array([0, 0, never], np.float32))
    starts, ends, first, joined, bounds = tokens(lines)
    if not len(starts):
        field.begin = np.array([0, never, never], np.float32)
        field.move = np.array([[0, never, never]] * 3, np.float32)
        return field
    tag = np.zeros(len(starts), np.int64)
    for k, spans in enumerate(marked):
        for a, b in spans:
            hit = np.flatnonzero((starts[first[k] : first[k + 1]] < bounds[k] + b) & (ends[first[k] : first[k + 1]] > bounds[k] + a)) + first[k]
            tag[hit] = 2
            tag[hit[:1]] = 1
    values = slots(joined, starts, ends, first)
    count = np.diff(first)
    use = np.flatnonzero(count)
    n, t_max = len(use), int(count.max())
    place = first[use][:, None] + np.arange(t_max)
    real = np.arange(t_max) < count[use][:, None]
    place = np.where(real, place, 0)
    gold = tag[place]
    one = np.eye(3, dtype=np.float32)
    memory = [np.full_like(w, 1e-6) for w in field.emit] + [np.full((3, 3), 1e-6, np.float32), np.full(3, 1e-6, np.float32)]
    for _ in range(steps):
        e = field.emissions(values)[place]
        alpha = np.zeros((t_max, n, 3))
        beta = np.zeros((t_max, n, 3))
        alpha[0] = field.begin + e[:, 0]
        for t in range(1, t_max):
            new = _logsum(alpha[t - 1][:, :, None] + field.move, 1) + e[:, t]
            alpha[t] = np.where(real[:, t, None], new, alpha[t - 1])
        for t in range(t_max - 2, -1, -1):
            new = _logsum(field.move + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(real[:, t + 1, None], new, beta[t])
        whole = _logsum(alpha[-1], 1)
        share = np.exp(np.minimum(alpha + beta - whole[:, None], 0)) * real.T[:, :, None]
        slope = np.zeros((len(starts), 3), np.float32)
        flat = real.ravel()
        slope[place.ravel()[flat]] = (one[gold] - share.transpose(1, 0, 2))[real]
        both = np.zeros((3, 3))
        for t in range(1, t_max):
            pair = alpha[t - 1][:, :, None] + field.move + (e[:, t] + beta[t])[:, None, :] - whole[:, None, None]
            both += (np.exp(np.minimum(pair, 0)) * real[:, t, None, None]).sum(0)
            np.subtract.at(both, (gold[real[:, t], t - 1], gold[real[:, t], t]), 1)
        grads = [np.column_stack([np.bincount(v, slope[:, y], len(w)) for y in range(3)]) / n - decay * w for w, v in zip(field.emit, values, strict=True)]
        grads += [-both / n, slope[first[use]].sum(0) / n]
        for w, g, m in zip([*field.emit, field.move, field.begin], grads, memory, strict=True):
            g = np.where(w <= -1e8, 0, g)
            m += (g * g).astype(np.float32)
            w += (rate * g / np.sqrt(m)).astype(np.float32)
    return field


def _invented(rng: random.Random) -> tuple[str, str]:
    """(text before, secret) of one invented secret."""
    alnum, low = string.ascii_letters + string.digits, "0123456789abcdef"
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    kind = rng.randrange(9)
    secret = (
        some(low, rng.choice([24, 32, 40, 64])), "AKIA" + some(string.ascii_uppercase + string.digits, 16), "ghp_" + some(alnum, 36), "sk_live_" + some(alnum, 24), f"xoxb-{some(string.digits, 11)}-{some(alnum, 24)}",
        some(alnum + "+/", 40), f"eyJ{some(alnum, 17)}.eyJ{some(alnum, 30)}.{some(alnum + '-_', 43)}", some(alnum, rng.randrange(20, 33)), some(alnum, rng.randrange(9, 14)) + rng.choice("!#%") + some(alnum, 3),
    )[kind]
    cue = rng.choice(["password", "secret", "token", "api_key", "key", "credential", "auth"])
    if kind == 8:  # short ones are secrets only beside a cue
        cue = rng.choice(["password", "passwd", "secret"])
    before = rng.choice([f"{cue} = ", f"{cue}: ", f"{cue}=", "Bearer ", f"{cue} is ", f"export {cue.upper()}=", f'"{cue}": ']) if kind == 8 or rng.random() < 0.6 else ""
    quote = rng.choice(["", '"', "'"])
    return before + quote, secret + quote


def _lookalike(rng: random.Random) -> str:
    """A token that looks like a secret and is none."""
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low = string.ascii_lowercase
    return rng.choice([
        some(string.digits, 16), f"{some(low, 6)}.{some(string.digits, 2)}@{some(low, 6)}.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", f"+{some(string.digits, 11)}",
        f"https://{some(low, 8)}.example.org/{some(low, 5)}/{some(string.digits, 4)}", f"{some(string.digits, 4)}-{some(string.digits, 2)}-{some(string.digits, 2)}", some(low, rng.randrange(14, 30)), f"v{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(9)}",
        some(low, 9).upper() + "!!", f"{some(string.digits, 3)}-{some(string.digits, 3)}-{some(string.digits, 4)}", f"{some(low, 7)}_{some(low, 8)}", f"{some(string.digits, 2)}:{some(string.digits, 2)}", f"{cue_word(rng)}:" + " none", f"{some(low, 5)}-{some(low, 9)}-{some(low, 7)}",
    ])


def cue_word(rng: random.Random) -> str:
    return rng.choice(["password", "secret", "token", "key", "auth"])


def sample_lines(texts: list[str], seed: int = 5, width: int = 24) -> tuple[list[bytes], list[list[tuple[int, int]]]]:
    """Training lines of at most ``width`` tokens: pieces of the texts, base matches marked, some with something put in."""
    rng = random.Random(seed)
    lines, marked = [], []
    for text in texts:
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        hot = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [(a, b) for a, k, b in base_spans(text) if k]
        places = [next((j for j, (x, y) in enumerate(words) if y > a), 0) for a, _ in hot[:4]] + [rng.randrange(len(words)) for _ in range(2) if words]
        for j in places:
            lo = max(0, j - rng.randrange(width // 2))
            piece = words[lo : lo + width]
            a, b = piece[0][0], piece[-1][1]
            own = sorted((max(x, a), min(y, b)) for x, y in hot if x < b and y > a)
            line, spans = text[a:b], [(x - a, y - a) for x, y in own]
            if not own and rng.random() < 0.75:
                cut = rng.choice(piece)[0] - a
                if rng.random() < 0.5:
                    before, secret = _invented(rng)
                    line = line[:cut] + before + secret + " " + line[cut:]
                    spans = [(cut + len(before), cut + len(before) + len(secret))]
                else:
                    line = line[:cut] + _lookalike(rng) + " " + line[cut:]
            at = lambda k, line=line: len(line[:k].encode())
            lines.append(line.encode())
            marked.append([(at(x), at(y)) for x, y in spans])
    return lines, marked


_TRIM = re.compile(rb"^[^0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff=/+]+$")


def _points(text: bytes, offsets: list[int]) -> list[int]:
    """Code point offsets of byte offsets (a count of lead bytes)."""
    lead = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    return [int(lead[o]) for o in offsets]


def scan(texts: list[bytes], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text: base spans and all spans, as (start, kind, end) in code points."""
    starts, ends, first, joined, bounds = tokens(texts)
    low = joined.lower()
    at = np.r_[_cues(low, _ASSIGN_WORDS), _cues(joined, (b"AKIA",))]
    is_hex = np.frombuffer(joined.translate(_is(b"0123456789abcdef")), np.int8)
    edge = np.flatnonzero(np.diff(np.r_[np.int8(0), is_hex, np.int8(0)]))
    at = np.r_[at, edge[::2][edge[1::2] - edge[::2] >= 24]]
    look = set((np.searchsorted(bounds, at, "right") - 1).tolist())
    e = field.emissions(slots(joined, starts, ends, first)) if len(starts) else np.zeros((0, 3), np.float32)
    found: dict[int, list[tuple[int, int]]] = {}
    for a, b in field.segments(e, first[:-1]):
        k = int(np.searchsorted(bounds, starts[a], "right")) - 1
        x, y = int(starts[a] - bounds[k]), int(ends[b - 1] - bounds[k])
        piece = texts[k][x:y]
        lead = _TRIM.match(piece)
        x += lead.end() if lead and lead.start() == 0 and lead.end() < len(piece) else 0
        tail = re.search(rb"[^0-9A-Za-z\x80-\xff=/+]+$", texts[k][x:y])
        y -= len(tail[0]) if tail and tail.start() > 0 else 0
        found.setdefault(k, []).append((x, y))
    out = []
    for k, t in enumerate(texts):
        base = base_spans(t.decode("utf-8", "replace")) if k in look else []
        more = []
        if k in found:
            p = _points(t, [o for s in found[k] for o in s])
            more = [(a, 3, b) for a, b in zip(p[::2], p[1::2], strict=True) if not any(x < b and a < y for x, _, y in base)]
        out.append((base, sorted(base + more)))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1500, sample_chars: int = 20_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf.

    The field is trained on pieces of at most ``sample_rows`` texts with a base match and
    as many others, distinct and of at most ``sample_chars`` code points each, the first by a hash;
    every whole text is scanned.  Null texts are empty, empty texts have no spans;
    repeated rows are scanned each; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    short = rows.where(F.length("text").between(1, sample_chars)).select("text", F.xxhash64("text").alias("h"))
    hot = F.col("text").rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}""")
    # the patterns run over all texts once; then one pass fetches the texts with hashes below their kind's cut, and looks again at those only
    marks = kept(short.select("h", hot.alias("hot")).distinct(), "marks")
    cuts = [marks.where(F.col("hot") == kind).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0] for kind in (True, False)]
    drop(marks)
    own = [F.lit(False) if cut is None else F.col("h") <= cut for cut in cuts]
    found = short.where((own[0] | own[1]) & ((own[0] & hot) | (own[1] & ~hot))).select("text", hot.alias("hot")).distinct().collect()
    texts = [t for _, t in sorted((not r["hot"], r["text"]) for r in found)]
    shared = spark.sparkContext.broadcast(train(*sample_lines(texts)))

    def run(batches):
        for batch in batches:
            for row, part in W.chunks(batch.column("text")):
                found = scan(part, shared.value)
                count = [[sum(s[1] == k for s in every) for _, every in found] for k in range(4)]
                base = [hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found]
                columns = [batch.column("doc_id").slice(row, len(part)), *(pa.array(c, pa.int64()) for c in count[:3]), pa.array(base, pa.string()), pa.array([written(s) for _, s in found], pa.string()), pa.array(count[3], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")
