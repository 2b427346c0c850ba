"""Secret scans by a linear-chain conditional random field over the tokens of a text.

Tokens are tagged begin, inside or outside from their shape, their neighbours and features of the whole file. Spans of three
fixed patterns (assignments, access keys, hexadecimal runs) are found exactly and always stay. What the field adds elsewhere is
of kind ``crf``.

The field learns from the fixed patterns' spans, but must not merely repeat them. So each span is also shown without its keyword
and separators, with its value spelt in other usual alphabets and lengths, and behind other words for credentials; texts without
secrets are shown at a hashed place, around the longest run of letters and of digits, and with a credential word, joined words and
groups of digits (as in paths, file names and numbers) among prose; tokens there that mix letters and digits are not shown, as they
may be secrets that no pattern knows. It is
fitted on two hash-ordered samples, of at most ``MAX_WITH`` documents that may hold base spans and ``MAX_WITHOUT`` others, and on at
most ``MAX_SPANS`` spans of a document, also in hash order. Where no document has a base span, the field is off.

Decoding is exact: where outside beats the other tags by more than any change of transitions could bring, the best path is
outside, so the chain falls into short stretches between such tokens, and Viterbi runs on these. Features are made for ``REACH``
bytes of a text at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.scratch import written
from tidewatch.shipping import ship

MAX_WITH, MAX_WITHOUT, MAX_SPANS = 800, 1500, 4
AROUND = 5  # tokens on each side of a span, or of a place without one, that the field is trained on
NEAR = 200  # characters on each side of a span that are kept as its context
REACH = 1 << 20
STEPS, RATE, RIDGE = 120, 0.1, 3e-2

KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# Words for credentials. All are one feature, so what is learnt of one holds for the others.
CREDENTIALS = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "auth", "authorization", "bearer", "credential", "credentials", "key", "passphrase", "pwd", "pass", "private_key", "secret_key", "access_key", "client_secret", "access_token", "auth_token")
_JOINS = (' = "', ": ", '="', " => '", ' "', " is: ", " ")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
MAY_HOLD = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
_KEYWORD = re.compile("|".join(sorted((x.replace("_", "[_-]?") for x in CREDENTIALS), key=len, reverse=True)).encode())
_CREDENTIALS = frozenset(x.encode() for x in CREDENTIALS)
_OUT, _BEGIN, _IN = 0, 1, 2


def _flags() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: what it adds to a token's shape (lower, upper, digit, mark, non-ASCII, not hexadecimal), and to a gap's."""
    shape, gap = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for c in range(256):
        ch = chr(c)
        if c >= 128:
            shape[c] = 16 | 32
        elif ch.isalpha():
            shape[c] = (1 if ch.islower() else 2) | (0 if ch in "abcdef" else 32)
        elif ch.isdigit():
            shape[c] = 4
        elif ch in "+/_.-":
            shape[c] = 8 | 32
        gap[c] = 1 if ch in "=:" else 2 if ch in "\"'" else 4 if ch == "\n" else 0
    return shape, gap


_SHAPE, _GAP = _flags()
_VOWEL = np.isin(np.arange(256), list(b"aeiouAEIOU"))
_LENGTHS = np.array([2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64])
#: Features and how many values each has.
SIZES = {"mask": 64, "long": 12, "mix": 9 * 8, "turns": 9, "vowels": 9, "before": 32, "after": 32, "gap": 8, "key": 2, "key2": 2, "prefix": 33, "file": 10}
_AT = dict(zip(SIZES, np.cumsum([0, *SIZES.values()])[:-1].tolist(), strict=True))


class Tokens:
    """Tokens of a text's bytes and their features; ``file``, if given, is that of the whole text that these bytes are part of."""

    def __init__(self, raw: bytes, file: int | None = None) -> None:
        data = np.frombuffer(raw, np.uint8)
        shape = _SHAPE[data]
        inside = np.concatenate([[False], shape > 0, [False]])
        self.starts, self.ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        n = self.n = len(self.starts)
        self.counts = (0, 0, False)
        if not n:
            return
        length = self.length = self.ends - self.starts
        mask = np.bitwise_or.reduceat(shape, self.starts)
        after = np.bitwise_or.reduceat(_GAP[data], self.starts)
        first = np.bitwise_or.reduce(_GAP[data[: self.starts[0]]]) if self.starts[0] else 0
        # A reduction from a start runs on over the gap behind it, where shapes are 0.
        digits = np.add.reduceat((shape == 4).astype(np.int32), self.starts)
        letters = np.add.reduceat(((shape & 3) > 0).astype(np.int32), self.starts)
        vowels = np.add.reduceat(_VOWEL[data].astype(np.int32), self.starts)
        kind = shape & 31
        turns = np.zeros(len(data), np.int32)
        turns[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        changes = np.add.reduceat(turns, self.starts)
        low = (mask & 31).astype(np.int64)
        self.mask = mask.astype(np.int64)
        self.long_at = np.searchsorted(_LENGTHS, length, "right")
        self.mix = (digits * 8 // length) * 8 + np.minimum(changes * 8 // length, 7)
        self.turns = np.minimum(changes, 8).astype(np.int64)
        self.vowels = np.where(letters > 0, vowels * 7 // np.maximum(letters, 1), 8).astype(np.int64)
        self.before, self.after = np.concatenate([[0], low[:-1]]), np.concatenate([low[1:], [0]])
        self.gap = np.concatenate([[first], after[:-1]]).astype(np.int64)
        self.keys = self._keys(raw.lower())
        self.long = np.flatnonzero(length >= 16)
        lead = np.zeros(len(self.long), np.int64)
        for k in range(4):
            lead = lead * 31 + data[self.starts[self.long] + k]
        self.lead = lead % 32 + 1
        self.counts = (n, int(np.count_nonzero(digits)), bool(self.keys))
        self.file = file_feature(*self.counts) if file is None else file

    def _keys(self, low: bytes) -> list[int]:
        """Indices of the tokens that are words for credentials."""
        found = []
        for m in _KEYWORD.finditer(low):
            k = int(np.searchsorted(self.starts, m.start()))
            if k < self.n and self.starts[k] == m.start() and self.ends[k] == m.end() and m.group() in _CREDENTIALS:
                found.append(k)
        return found

    def features(self, at: np.ndarray) -> np.ndarray:
        """Columns of the weight table for the tokens ``at``."""
        key, key2, prefix = np.zeros(self.n + 2, np.int64), np.zeros(self.n + 2, np.int64), np.zeros(self.n, np.int64)
        for k in self.keys:
            key[k + 1], key2[k + 2] = 1, 1
        prefix[self.long] = self.lead
        own = {
            "mask": self.mask, "long": self.long_at, "mix": self.mix, "turns": self.turns, "vowels": self.vowels, "before": self.before, "after": self.after, "gap": self.gap,
            "key": key[: self.n], "key2": key2[: self.n], "prefix": prefix,
        }
        return np.stack([*(own[f][at] + _AT[f] for f in own), np.full(len(at), self.file + _AT["file"])], axis=1)


def file_feature(n: int, with_digits: int, keys: bool) -> int:
    """How many of a text's tokens have digits, and whether any is a word for credentials."""
    return int(np.searchsorted([1e-9, 0.01, 0.05, 0.2], with_digits / max(n, 1), "right")) * 2 + bool(keys)


def stretches(raw: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, first, last): tokens that start in first..last, to be read with what stands in from..to around them."""
    if len(raw) <= REACH:
        yield 0, len(raw), 0, len(raw)
        return
    data = np.frombuffer(raw, np.uint8)

    def edge(at: int, step: int, tokens: int) -> int:
        """Where ``tokens`` more tokens have ended, going by ``step`` from a place between tokens."""
        was = False
        while 0 <= (at if step > 0 else at - 1) < len(raw):
            now = bool(_SHAPE[data[at if step > 0 else at - 1]])
            if was and not now:
                tokens -= 1
                if not tokens:
                    break
            was, at = now, at + step
        return at

    first = 0
    while first < len(raw):
        last = min(len(raw), first + REACH)
        while last < len(raw) and _SHAPE[data[last - 1]] and _SHAPE[data[last]]:
            last += 1
        yield (edge(first, -1, 3) if first else 0), edge(last, 1, 1), first, last
        first = last


class Field:
    """Weights of features by tag, and of transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.moves = moves
        part = self.part = {f: weights[_AT[f] : _AT[f] + n] for f, n in SIZES.items()}
        self.own = part["mask"][:, None, :] + part["long"][None, :, :]
        self.way = part["turns"][:, None, :] + part["vowels"][None, :, :]
        self.around = part["before"][:, None, None] + part["after"][None, :, None] + part["gap"][None, None, :]
        t = moves
        ways = [t[a, y] + t[y, c] - t[a, _OUT] - t[_OUT, c] for y in (_BEGIN, _IN) for a in range(3) for c in range(3)]
        ways += [t[a, y] - t[a, _OUT] for y in (_BEGIN, _IN) for a in range(3)] + [t[y, c] - t[_OUT, c] for y in (_BEGIN, _IN) for c in range(3)]
        self.most = max(0.0, *ways) + 1e-9

    def scores(self, t: Tokens) -> np.ndarray:
        s = self.own[t.mask, t.long_at] + self.part["mix"][t.mix] + self.way[t.turns, t.vowels] + self.around[t.before, t.after, t.gap]
        s += self.part["file"][t.file] + self.part["key"][0] + self.part["key2"][0] + self.part["prefix"][0]
        for k in t.keys:
            if k + 1 < t.n:
                s[k + 1] += self.part["key"][1] - self.part["key"][0]
            if k + 2 < t.n:
                s[k + 2] += self.part["key2"][1] - self.part["key2"][0]
        s[t.long] += self.part["prefix"][t.lead] - self.part["prefix"][0]
        return s

    def spans(self, raw: bytes) -> list[tuple[int, int]]:
        """Byte ranges tagged as secrets on the best path."""
        parts, whole = list(stretches(raw)), None
        if len(parts) > 1:
            counts = np.zeros(3, np.int64)
            for _, _, first, last in parts:
                counts += np.array(Tokens(raw[first:last]).counts, np.int64)
            whole = file_feature(*counts.tolist())
        at, start, end, score, done = [], [], [], [], 0
        for low, high, first, last in parts:
            t = Tokens(raw[low:high], whole)
            if not t.n:
                continue
            own = (t.starts >= first - low) & (t.starts < last - low)
            s = self.scores(t)
            k = np.flatnonzero(own & (s[:, _OUT] - np.maximum(s[:, _BEGIN], s[:, _IN]) <= self.most))
            at.append(done + k - int(np.argmax(own))), start.append(t.starts[k] + low), end.append(t.ends[k] + low), score.append(s[k])
            done += int(own.sum())
        if not done:
            return []
        at, start, end, s = np.concatenate(at), np.concatenate(start), np.concatenate(end), np.concatenate(score)
        out: list[tuple[int, int]] = []
        for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
            a, e = int(run[0]), int(run[-1]) + 1
            for k, tag in zip(range(a, e), self._best(s[a:e], at[a] > 0, at[e - 1] + 1 < done), strict=True):
                if tag == _IN and out and k > a and out[-1][1] == end[k - 1]:
                    out[-1] = (out[-1][0], int(end[k]))
                elif tag != _OUT:
                    out.append((int(start[k]), int(end[k])))
        return out

    def _best(self, s: np.ndarray, left: bool, right: bool) -> list[int]:
        """Viterbi, with outside on the sides that are not ends of the text."""
        best = s[0] + (self.moves[_OUT] if left else 0)
        back = []
        for row in s[1:]:
            ways = best[:, None] + self.moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        tag = int((best + (self.moves[:, _OUT] if right else 0)).argmax())
        tags = [tag]
        for step in reversed(back):
            tag = int(step[tag])
            tags.append(tag)
        return tags[::-1]


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns in code points, by start and then kind.

    ``raw`` (the text's bytes) only tells where a pattern can't match.
    """
    raw = text.encode() if raw is None else raw
    low, out = raw.lower(), []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _LONG_HEX.search(text):
        out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def _leads(raw: bytes) -> np.ndarray:
    """Byte offsets of the code points, with the text's end."""
    data = np.frombuffer(raw, np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _hashed(*parts: object) -> bytes:
    return hashlib.blake2b(repr(parts).encode(), digest_size=64).digest()


def respelt(value: str, salt: int) -> str:
    """Random characters made of a value's digest, in one of the usual alphabets of keys, 16 to 64 long."""
    h = _hashed(value, salt)
    n, kind = 16 + h[0] % 49, h[1] % 6
    own = _hashed(value, salt, "text")
    if kind == 0:
        text = own.hex().upper()
    elif kind == 1:
        text = base64.b64encode(own).decode().rstrip("=")
    elif kind == 2:
        text = base64.b32encode(own).decode().rstrip("=")
    elif kind == 3:
        text = base64.urlsafe_b64encode(own).decode().rstrip("=")
    else:
        text = re.sub("[+/]", "", base64.b64encode(own + _hashed(value, salt, "more")).decode().rstrip("="))
    return f"{text[:3].lower()}{'_-'[h[2] % 2]}{text[3:n]}" if kind == 5 else text[:n]


def decoy(words: list[str], salt: bytes) -> str:
    """Long tokens that are no secrets: words joined as in paths and names, with or without a number, dates, and groups of digits."""
    number = str(int.from_bytes(salt[:8], "big"))
    mark, kind = "-_/."[salt[8] % 4], salt[9] % 4
    if kind == 0:
        return mark.join(number[k : k + 1 + salt[10 + k] % 6] for k in range(2 + salt[10] % 4))
    some = [re.sub(r"[^\w]|_", "", x) or "x" for x in words[: 2 + salt[10] % 7]]
    if kind == 1 and len(some) > 2:
        date = f"20{number[:2]}/0{number[2]}/" if salt[12] % 2 else ""
        return f"{('', 'https://')[salt[14] % 2]}{some[0]}.{some[1]}.{'comorg'[salt[13] % 2 * 3 :][:3]}/{date}{mark.join(some[2:])}{mark}{number[: salt[11] % 7]}"
    if kind == 2:
        return f"{some[0][:3].upper()}{mark}20{number[:6]}{mark}{number[3:9]}{('.jpg', '.pdf', '', '-v2')[salt[11] % 4]}"
    return mark.join(some) if salt[11] % 2 else "".join(x[:1].upper() + x[1:] for x in some)


def _stretch(text: str, file: int, spans: list[tuple[int, int]], place: tuple[int, int] | None = None) -> tuple[bytes, bytes] | None:
    """Features and tags of the tokens around ``spans`` (or a place without any), both in code points."""
    raw = text.encode()
    t, at = Tokens(raw, file), _leads(raw)
    if not t.n:
        return None
    tags, ends = np.zeros(t.n, np.int8), []
    for a, e in spans or [place]:
        k, m = int(np.searchsorted(t.ends, at[a], "right")), int(np.searchsorted(t.starts, at[e]))
        ends += [k, m]
        if spans and k < m:
            tags[k], tags[k + 1 : m] = _BEGIN, _IN
    x = np.arange(max(0, min(ends) - AROUND), min(t.n, max(ends) + AROUND))
    return (t.features(x).astype(np.int16).tobytes(), tags[x].tobytes()) if len(x) else None


def _cut(text: str, a: int, e: int) -> tuple[str, str]:
    """What stands before and behind a span, without the words that are cut off."""
    left, right = text[max(0, a - NEAR) : a], text[e : e + NEAR]
    left = left if a <= NEAR else left[len(left) - len(left.lstrip()) :] if left[:1].isspace() else left.partition(" ")[2]
    return left, right if e + NEAR >= len(text) else right.rpartition(" ")[0]


def _shown(doc: object, text: str) -> Iterator[tuple[bytes, bytes] | None]:
    """What the field is shown of a document."""
    raw = text.encode()
    counts = np.zeros(3, np.int64)
    longest: dict[bool, tuple[int, int, int]] = {}
    mixed: list[tuple[int, int]] = []
    at, base = _leads(raw), base_spans(text, raw)
    taken = [(a, e) for a, _, e, _ in base]
    for _, _, first, last in stretches(raw):
        t = Tokens(raw[first:last])
        counts += np.array(t.counts, np.int64)
        if not t.n:
            continue
        place = lambda k: (int(np.searchsorted(at, t.starts[k] + first)), int(np.searchsorted(at, t.ends[k] + first)))  # noqa: B023, E731
        kind = t.mask & 7
        for digits in (False, True):
            n = np.where((kind == 4) if digits else (kind < 4), t.length, 0)
            k = int(n.argmax())
            if n[k] > longest.get(digits, (0,))[0]:
                longest[digits] = (int(n[k]), *place(k))
        mixed += [place(k) for k in np.flatnonzero((kind > 4) & (t.length >= 8))]
    file = file_feature(*counts.tolist())
    values: dict[tuple[int, int], int] = {}  # the same value may be matched by several patterns
    for a, _, e, v in base:
        values[v, e] = min(a, values.get((v, e), a))
    chosen = sorted(values.items(), key=lambda x: _hashed(doc, x))[:MAX_SPANS]
    for (v, e), a in chosen:
        value, key = text[v:e], text[a:v]
        left, right = _cut(text, a, e)
        h = _hashed(doc, a)
        new, other, join = respelt(value, h[0]), CREDENTIALS[h[1] % len(CREDENTIALS)], _JOINS[h[2] % len(_JOINS)]
        short = respelt(value, h[3])[: 8 + h[4] % 8]
        for before, x in ((key, value), ("", value), (key, new), ("", new), ("", respelt(value, h[5])), (f"{other}{join}", new), (f"{other}{join.rstrip() or ':'} ", short)):
            at_x = len(left) + len(before)
            yield _stretch(f"{left}{before}{x}{right}", file, [(at_x, at_x + len(x))])
    taken += mixed
    clear = lambda a, e: not any(x < e and a < y for x, y in taken)
    for _, *place in longest.values():
        left, right = _cut(text, *place)
        if clear(place[0] - len(left), place[1] + len(right)):
            yield _stretch(left + text[place[0] : place[1]] + right, file, [], (len(left), len(left) + place[1] - place[0]))
    h = _hashed(doc, len(text))
    k = int.from_bytes(h[:8], "big") % len(text)
    left, right = _cut(text, k, k)
    if clear(k - len(left), k + len(right)):
        yield _stretch(left + right, file, [], (len(left), len(left)))
        word = CREDENTIALS[h[8] % len(CREDENTIALS)]
        left = left.rpartition(" ")[0] + " " if " " in left else ""
        yield _stretch(f"{left}{word} {right.lstrip()}", file, [], (len(left), len(left) + len(word)))
        word = decoy(right.split() or ["x"], h[16:])
        yield _stretch(f"{left}{word} {right.lstrip()}", file, [], (len(left), len(left) + len(word)))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(doc, k, *x) for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True) if text for k, x in enumerate(_shown(doc, text)) if x]
        doc, place, features, tags = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.string()), pa.array(place, pa.int64()), pa.array(features, pa.binary()), pa.array(tags, pa.binary())], ["doc", "place", "features", "tags"])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def fit(stretches: list[tuple[np.ndarray, np.ndarray]]) -> Field:
    """Weights of largest likelihood with a ridge, by Adam with exact gradients (forward-backward over all stretches at once)."""
    width = sum(SIZES.values())
    weights, moves = np.zeros((width, 3)), np.zeros((3, 3))
    if not any(tags.any() for _, tags in stretches):
        weights[_AT["file"] : _AT["file"] + SIZES["file"], _OUT] = 100.0  # nothing to learn from: nothing is found
        return Field(weights, moves)
    stretches = sorted(stretches, key=lambda x: -len(x[1]))
    lens = np.array([len(tags) for _, tags in stretches])
    n, steps = len(lens), int(lens.max())
    f = np.zeros((steps, n, len(SIZES)), np.int16)
    y = np.zeros((steps, n), np.int64)
    for k, (features, tags) in enumerate(stretches):
        f[: len(tags), k], y[: len(tags), k] = features, tags
    live = [int((lens > t).sum()) for t in range(steps)]  # stretches are sorted: the first so many have a token there
    has = np.arange(steps)[:, None] < lens[None, :]
    flat, total = f[has], int(lens.sum())
    theta = np.concatenate([weights.ravel(), moves.ravel()])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    want = np.zeros((steps, n, 3))
    np.put_along_axis(want, y[:, :, None], 1.0, axis=2)
    for k in range(1, STEPS + 1):
        weights, moves = theta[:-9].reshape(width, 3), theta[-9:].reshape(3, 3)
        s = np.zeros((steps, n, 3))
        s[has] = weights[flat].sum(axis=1)
        alpha, beta = np.zeros((steps, n, 3)), np.zeros((steps, n, 3))
        alpha[0] = s[0]
        for t in range(1, steps):
            a = live[t]
            alpha[t, :a] = s[t, :a] + _lse(alpha[t - 1, :a, :, None] + moves, 1)
        for t in range(steps - 2, -1, -1):
            a = live[t + 1]
            beta[t, :a] = _lse(moves + (s[t + 1, :a] + beta[t + 1, :a])[:, None, :], 2)
        z = _lse(alpha[0] + beta[0], 1)
        p = np.exp(np.minimum(alpha + beta - z[None, :, None], 0))
        err = (p - want)[has]
        g_moves = np.zeros((3, 3))
        for t in range(1, steps):
            a = live[t]
            pair = alpha[t - 1, :a, :, None] + moves + (s[t, :a] + beta[t, :a])[:, None, :] - z[:a, None, None]
            g_moves += np.exp(np.minimum(pair, 0)).sum(axis=0)
            np.add.at(g_moves, (y[t - 1, :a], y[t, :a]), -1.0)
        g = np.stack([np.bincount(flat.ravel(), weights=np.repeat(err[:, c], flat.shape[1]), minlength=width) for c in range(3)], axis=1)
        grad = np.concatenate([g.ravel(), g_moves.ravel()]) / total + RIDGE * theta / total
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta = theta - RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Field(theta[:-9].reshape(width, 3), theta[-9:].reshape(3, 3))


def train(docs: DataFrame, max_with: int = MAX_WITH, max_without: int = MAX_WITHOUT) -> Field:
    """The field from two bounded samples of documents; of rows that repeat an id, each place counts once."""
    ship(docs.sparkSession)
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("string").alias("doc"), "text")
    ids = written(rows.groupBy("doc").agg(F.max(F.col("text").rlike(MAY_HOLD)).alias("may")), "secret-ids")
    of = lambda may, n: ids.where(F.col("may") == may).orderBy(F.xxhash64("doc"), "doc").limit(n).select("doc")
    sample = of(True, max_with).unionByName(of(False, max_without))  # what is broadcast has this bound
    rows = rows.join(F.broadcast(sample), "doc", "left_semi")
    found = rows.mapInArrow(_examples, "doc string, place long, features binary, tags binary").toPandas().sort_values(["doc", "place", "features", "tags"]).drop_duplicates(["doc", "place"])
    return fit([(np.frombuffer(x, np.int16).reshape(-1, len(SIZES)), np.frombuffer(t, np.int8)) for x, t in zip(found["features"], found["tags"], strict=True)])


def scan(text: str | None, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind, end) in code points; spans of the field that touch a base span are left out."""
    if not text:
        return [], []
    raw = text.encode()
    base = [x[:3] for x in base_spans(text, raw)]
    added = field.spans(raw)
    if added:
        at = _leads(raw)
        cuts = [(int(np.searchsorted(at, a)), int(np.searchsorted(at, e))) for a, e in added]
        starts, ends = [a for a, _, _ in base], list(accumulate((e for _, _, e in base), max))  # base spans come by start
        before = ((a, e, bisect_left(starts, e)) for a, e in cuts)
        added = [(a, 3, e) for a, e, k in before if not k or ends[k - 1] <= a]
    return base, sorted([*base, *added])


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


def _scan(field_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = field_of.value
        for b in batches:
            found = [scan(t, field) for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(x[1] == k for x in base) for base, _ in found], pa.int64()) for k in range(3)]
            sha = pa.array([hashlib.sha256(_line(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, sha, pa.array([_line(every) for _, every in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, max_with: int = MAX_WITH, max_without: int = MAX_WITHOUT) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end`` by start and kind, comma-joined).

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows that repeat are each reported. Where the
    sample has no base span, or the table no rows, the field adds nothing. Only doc_id and text are read.
    """
    field = ship(docs.sparkSession).sparkContext.broadcast(train(docs, max_with, max_without))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_scan(field), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
