"""Personal data in texts: base patterns, and a linear-chain conditional random field over word shapes.

The base patterns find e-mail addresses, IP addresses, payment cards and phone numbers that are written by the book. The field
adds those that are not (``name (at) host dot net``, ``(020) 555 01 23``). It labels words by their shapes: counts of
digits, letters, dots, hyphens and at-signs, the classes of the first and last character, a few telling words, and the same of the
words before and after. A word without digit or sign that does not stand beside an at/dot word is outside by a hard constraint, so
that the chain falls apart at such words and the Viterbi search runs over the runs between them, all runs of an Arrow batch at
once; the result is that of the whole chain. Weights come from a small labelled table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelake.llm.textkit import LOWER, U, pieces, utf8, words

KINDS = ("email", "ip", "card", "phone")
EMAIL_END = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# a match from within a run of digits exists only where one from its first digit does, so only first digits are tried
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: labelled rows that are made when the caller brings none, and the bound for those that are brought
ROWS, MOST_ROWS = 1_000, 20_000
STEPS, RATE, L2, SEED = 100, 0.1, 1e-3, 3
# fixed values: telling words (eight letters at most are compared) and their groups
LEXICON = {"at": 1, "(at)": 1, "[at]": 1, "dot": 2, "(dot)": 2, "[dot]": 2, "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3, "telefon": 3, "mail": 4, "email": 4, "e-mail": 4, "contact": 4, "card": 5, "visa": 5, "credit": 5, "ip": 6, "address": 6, "server": 6, "order": 7, "invoice": 7, "version": 7, "page": 7, "year": 7, "id": 7, "no": 7}
AT_DOT = (1, 2)
STATES = ("O", "B-email", "I-email", "B-ip", "B-card", "I-card", "B-phone", "I-phone")
#: values of each feature: telling word, digits, letters, at-signs, dots, hyphens, first and last character, other signs
SIZES = (8, 8, 3, 3, 5, 4, 6, 4, 2)


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_DIGIT, _UPPER = _flags("0123456789"), _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _flags("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_SIGN = _DIGIT | _flags("@+")
_TAIL = _flags(".,;:!?\"'")
_PACKED = sorted((int.from_bytes(w.encode(), "little"), g) for w, g in LEXICON.items())
_LEX_KEYS, _LEX_GROUPS = np.array([k for k, _ in _PACKED], U), np.array([g for _, g in _PACKED], np.int64)


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape code, telling word, has a digit or sign) of each word."""
    n = len(starts)
    padded = np.concatenate((raw, np.zeros(9, np.uint8)))
    stop = ends - (_TAIL[raw[ends - 1]] & (ends - starts > 1)) if n else ends
    size = stop - starts
    key = np.zeros(n, U)
    short = np.flatnonzero(size <= 8)
    for k in range(8):
        some = short[size[short] > k]
        key[some] |= LOWER[padded[starts[some] + k]].astype(U) << U(8 * k)
    at = np.minimum(np.searchsorted(_LEX_KEYS, key), len(_LEX_KEYS) - 1)
    lex = np.where((size <= 8) & (_LEX_KEYS[at] == key), _LEX_GROUPS[at], 0)
    signs = np.concatenate(([0], np.cumsum(_SIGN[raw])))
    marked = signs[ends] > signs[starts]
    code = lex.copy()
    scale = SIZES[0]
    m = np.flatnonzero(marked)

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag[raw], dtype=np.int32)))
        return (total[stop[m]] - total[starts[m]]).astype(np.int64)

    first = np.where(_UPPER[raw[starts]], 1, 0) if n else np.zeros(0, np.int64)
    columns = [np.zeros(n, np.int64) for _ in SIZES[1:]]
    columns[1][:] = 2
    columns[5] = first.astype(np.int64)
    columns[6][:] = 1
    if len(m):
        digits, letters, ats, dots, hyphens = count(_DIGIT), count(_LETTER), count(_flags("@")), count(_flags(".")), count(_flags("-"))
        head, foot = raw[starts[m]], raw[stop[m] - 1]
        columns[0][m] = np.searchsorted([1, 3, 4, 5, 7, 12, 20], digits, side="right")
        columns[1][m] = np.minimum(letters, 3) - (letters >= 2)
        columns[2][m] = np.minimum(ats, 2)
        columns[3][m] = np.minimum(dots, 4)
        columns[4][m] = np.minimum(hyphens, 3)
        columns[5][m] = np.select([_DIGIT[head], head == ord("+"), head == ord("("), _UPPER[head], _LETTER[head]], [2, 3, 4, 1, 0], 5)
        columns[6][m] = np.select([_DIGIT[foot], _LETTER[foot], foot == ord(")")], [0, 1, 2], 3)
        columns[7][m] = (digits + letters + ats + dots + hyphens < stop[m] - starts[m]).astype(np.int64)
    for c, s in zip(columns, SIZES[1:]):
        code += c * scale
        scale *= s
    return code, lex, marked


_OFFSETS = np.concatenate(([0], np.cumsum(SIZES)))
_WIDTH = int(_OFFSETS[-1]) + SIZES[1] * SIZES[4] + SIZES[1] * SIZES[5] + 1


def _indicators(codes: np.ndarray) -> np.ndarray:
    """One row of 0/1 features for each shape code."""
    values, rest = [], codes.copy()
    for s in SIZES:
        values.append(rest % s)
        rest //= s
    out = np.zeros((len(codes), _WIDTH))
    r = np.arange(len(codes))
    for j, v in enumerate(values):
        out[r, _OFFSETS[j] + v] = 1
    out[r, _OFFSETS[-1] + values[1] * SIZES[4] + values[4]] = 1
    out[r, _OFFSETS[-1] + SIZES[1] * SIZES[4] + values[1] * SIZES[5] + values[5]] = 1
    out[:, -1] = 1
    return out


#: transitions that the labels rule out
_RULED = np.zeros((len(STATES), len(STATES)))
for _i, _a in enumerate(STATES):
    for _j, _b in enumerate(STATES):
        if _b[0] == "I" and _a[2:] != _b[2:]:
            _RULED[_i, _j] = -1e9
_NOBODY = -1  # the code of the place before the first and after the last word of a text


class _Words:
    """Words of the texts of an Arrow batch piece, with runs of words that may be inside something."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.first = words(raw, offsets)
        n = len(self.starts)
        self.code, lex, marked = _shapes(raw, self.starts, self.ends)
        begin = np.zeros(n + 1, bool)
        begin[self.first[:-1]] = True
        begin = begin[:n]
        edge = np.append(begin[1:], True)
        near = np.isin(lex, AT_DOT)
        free = marked | (lex > 0)
        free[1:] |= near[:-1] & ~begin[1:]
        free[:-1] |= near[1:] & ~begin[1:]
        self.free = np.flatnonzero(free)
        joined = np.zeros(len(self.free), bool)
        joined[1:] = (np.diff(self.free) == 1) & ~begin[self.free[1:]]
        self.run = np.flatnonzero(~joined)
        self.length = np.diff(np.append(self.run, len(self.free)))
        before = np.where(begin, _NOBODY, np.append(_NOBODY, self.code[:-1])) if n else self.code
        after = np.where(edge, _NOBODY, np.append(self.code[1:], _NOBODY)) if n else self.code
        self.codes = np.stack((before, self.code, after))[:, self.free]


class Field:
    """Weights of the conditional random field: for the shapes before, at and after a word, and for transitions."""

    def __init__(self, shape: np.ndarray, move: np.ndarray):
        self.shape, self.move = shape, move

    def scores(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros((codes.shape[1], len(STATES)))
        for k in range(3):
            known, at = np.unique(codes[k], return_inverse=True)
            x = _indicators(np.maximum(known, 0)) * (known >= 0)[:, None]
            total += (x @ self.shape[k])[at]
        return total

    def decode(self, w: _Words) -> np.ndarray:
        """The most likely states of the free words: Viterbi over all runs at once, the longest first."""
        e = self.scores(w.codes)
        move = self.move + _RULED
        order = np.argsort(-w.length, kind="stable")
        start, length = w.run[order], w.length[order]
        out = np.zeros(len(w.free), np.int64)
        if not len(order):
            return out
        back = np.zeros((len(w.free), len(STATES)), np.int8)
        best = e[start] + move[0]
        active = [len(order)]
        for t in range(1, int(length[0])):
            k = int(np.searchsorted(-length, -t, side="left"))
            active.append(k)
            options = best[:k, :, None] + move[None]
            back[start[:k] + t] = options.argmax(1)
            best[:k] = options.max(1) + e[start[:k] + t]
        state = (best + move[:, 0]).argmax(1)  # what follows a run is outside
        for t in range(int(length[0]) - 1, -1, -1):
            k = active[t]
            out[start[:k] + t] = state[:k]
            state[:k] = back[start[:k] + t, state[:k]] if t else state[:k]
        return out


def made_rows(rows: int = ROWS, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled texts by rule: (text, spans of (kind, start, end))."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    some = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=n))
    syllables = "an re ti on er in the ed ing tion ha or es st ly to en ou ch ei un der la que os mi ar".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    host = lambda: f"{word()}.{pick(['com', 'net', 'org', 'example.com'])}"

    def card() -> str:
        head = pick("45") + digits(14)
        return head + next(c for c in "0123456789" if _luhn(head + c))

    made = {
        "email": lambda: pick([f"{word()}.{digits(2)}@mail{digits(1)}.example.com", f"{word()}@{host()}", f"{word()} at {word()} dot {pick(['com', 'net', 'org'])}", f"{word()} (at) {word()} (dot) com", f"{word()} [at] {word()} [dot] org", f"{word()} (at) {host()}", f"{word()}{digits(2)} at {host()}"]),
        "ip": lambda: ".".join(str(int(x)) for x in rng.integers(0, 256, 4)),
        "card": lambda: pick(["", " ", "-", "."]).join(re.findall("....", card())),
        "phone": lambda: pick([f"+1 ({digits(3)}) 555-{digits(4)}", f"+49 {digits(3)} {digits(7)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)} {digits(2)} {digits(2)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)} {digits(3)} {digits(4)}"]),
    }
    lead = {"email": ["mail ", "email: ", "contact ", ""], "ip": ["ip ", "server ", "address ", ""], "card": ["card ", "visa ", "credit card ", ""], "phone": ["phone ", "tel ", "call ", "mobile "]}
    hexa = "0123456789abcdef"
    harmless = [
        lambda: f"{pick(['version', 'Version', 'page', 'year', 'order', 'invoice', 'no', 'id'])} {digits(int(rng.integers(1, 9)))}", lambda: f"{digits(1)}.{digits(1)}", lambda: f"({digits(4)})",
        lambda: f"password={some(hexa, 18)}", lambda: f'token = "{some(hexa, 40)}"', lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
        lambda: f"at {word()}", lambda: f"{word()} at {word()}", lambda: f"dot {word()}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"${digits(3)},{digits(3)}.{digits(2)}", lambda: f"@{word()}",
        lambda: f"{digits(2)} {word()} {digits(3)}", lambda: f"{digits(3)} {digits(2)} {digits(1)}", lambda: some(hexa, 32), lambda: f"{digits(int(rng.integers(1, 7)))}", lambda: f"C++ {word()}", lambda: f"+{digits(1)}", lambda: f"{word()}{digits(2)}",
        lambda: f"order {digits(10)}", lambda: f"invoice {digits(4)}-{digits(6)}", lambda: f"{word()}-{digits(4)}", lambda: f"{digits(3)}-{digits(4)}", lambda: f"{word()} at {digits(2)} {word()}", lambda: f"{digits(7)} {word()}",
    ]
    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 5))):
            text += " ".join(word() for _ in range(int(rng.integers(1, 7)))) + pick([" ", " ", ". ", ", "])
            if rng.random() < 0.5:
                kind = pick(KINDS)
                text += pick(lead[kind])
                value = made[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + pick([" ", " ", ". ", ", "])
            else:
                text += pick(harmless)() + pick([" ", " ", ". ", ", "])
        out.append((text.rstrip(), spans))
    return out


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]] | None = None, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> Field:
    """The field learned from labelled texts (at most ``MOST_ROWS`` are used) by gradient ascent on the likelihood."""
    rows = (made_rows() if rows is None else rows)[:MOST_ROWS]
    raw, offsets = utf8(pa.array([t for t, _ in rows], pa.string()))
    w = _Words(raw, offsets)
    gold = np.zeros(len(w.starts), np.int64)
    for i, (text, spans) in enumerate(rows):
        own = np.arange(w.first[i], w.first[i + 1])
        for kind, a, b in spans:
            a, b = (len(text[:x].encode()) + offsets[i] for x in (a, b))
            inside = own[(w.starts[own] < b) & (w.ends[own] > a)]
            gold[inside] = STATES.index(f"I-{kind}") if f"I-{kind}" in STATES else STATES.index(f"B-{kind}")
            gold[inside[:1]] = STATES.index(f"B-{kind}")
    gold = gold[w.free]
    s, n = len(STATES), int(w.length.max())
    at = w.run[:, None] + np.arange(n)
    live = np.arange(n) < w.length[:, None]
    at = np.where(live, at, 0)
    uniques = [np.unique(c, return_inverse=True) for c in w.codes]
    x = [_indicators(np.maximum(u, 0)) * (u >= 0)[:, None] for u, _ in uniques]
    shape, move = np.zeros((3, _WIDTH, s)), np.zeros((s, s))
    hot = np.eye(s)
    truth = [np.stack([np.bincount(i, hot[gold][:, k], len(u)) for k in range(s)], 1) for u, i in uniques]
    before = np.where(np.isin(np.arange(len(gold)), w.run), 0, np.append(0, gold[:-1]))
    moves = np.zeros((s, s))
    np.add.at(moves, (before, gold), 1)
    np.add.at(moves, (gold[w.run + w.length - 1], 0), 1)
    first, second = [np.zeros_like(shape), np.zeros_like(move)], [np.zeros_like(shape), np.zeros_like(move)]

    def lse(v, axis):
        top = v.max(axis, keepdims=True)
        return (top + np.log(np.exp(v - top).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        e, m = sum((x[k] @ shape[k])[i] for k, (_, i) in enumerate(uniques)), move + _RULED
        ahead = np.zeros((n, len(w.run), s))
        ahead[0] = e[at[:, 0]] + m[0]
        for t in range(1, n):
            ahead[t] = np.where(live[:, t, None], lse(ahead[t - 1][:, :, None] + m[None], 1) + e[at[:, t]], ahead[t - 1])
        total = lse(ahead[n - 1] + m[:, 0], 1)
        behind = np.broadcast_to(m[:, 0], (len(w.run), s)).copy()
        grad_e, grad_m = np.zeros((len(gold), s)), np.zeros((s, s))
        last = np.exp(ahead[n - 1] + m[:, 0] - total[:, None])
        grad_m[:, 0] += last.sum(0)
        for t in range(n - 1, -1, -1):
            p = np.exp(ahead[t] + behind - total[:, None]) * live[:, t, None]
            grad_e[at[live[:, t], t]] = p[live[:, t]]
            if t:
                pair = np.exp(ahead[t - 1][:, :, None] + m[None] + (e[at[:, t]] + behind)[:, None, :] - total[:, None, None]) * live[:, t, None, None]
                grad_m += pair.sum(0)
                behind = np.where(live[:, t, None], lse(m[None] + (e[at[:, t]] + behind)[:, None, :], 2), behind)
            else:
                grad_m[0] += p.sum(0)
        g_shape = np.stack([x[k].T @ (truth[k] - np.stack([np.bincount(i, grad_e[:, j], len(u)) for j in range(s)], 1)) for k, (u, i) in enumerate(uniques)]) / len(w.run) - l2 * shape
        g_move = (moves - grad_m) / len(w.run) - l2 * move
        for k, (value, g) in enumerate(((shape, g_shape), (move, g_move))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            value += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Field(shape, move)


def _luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the base patterns, leftmost and not overlapping for each kind."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > free and LOCAL.match(text[a - 1]):
            a -= 1
        m = EMAIL_END.match(text, at + 1) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group()) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _fits(kind: int, value: str) -> bool:
    """Whether a span that the field proposes can be what it says."""
    digits = re.sub(r"[^0-9]", "", value)
    if kind == 0:
        return bool(re.fullmatch(r"\S+\s*(?:@|\s[(\[]?at[)\]]?\s)\s*\S+(?:\s*(?:\.|\s[(\[]?dot[)\]]?\s)\s*\w+)+", value, re.I))
    if kind == 1:
        return bool(IP.fullmatch(value)) and all(int(p) <= 255 for p in value.split(".") if len(p) < 9)
    if kind == 2:
        return 12 <= len(digits) <= 19 and _luhn(digits) and not re.search(r"[^\W\d_]", value)
    return 7 <= len(digits) <= 15 and not re.search(r"[^\W\d_]", value) and bool(re.search(r"[\s()-]", value.strip("()")))


def _spans(field: Field, column: pa.Array) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, as (start, index of the kind, end) in code points."""
    raw_all, offsets_all = utf8(column)
    out = []
    for a, b in pieces(offsets_all):
        raw, offsets = raw_all[offsets_all[a]: offsets_all[b]], offsets_all[a: b + 1] - offsets_all[a]
        w = _Words(raw, offsets)
        states = field.decode(w)
        inside = np.flatnonzero(states)
        proposals: dict[int, list[tuple[int, int, int]]] = {}
        row = np.searchsorted(w.first, w.free[inside], side="right") - 1
        for i, r in zip(inside.tolist(), row.tolist()):
            name, word = STATES[states[i]], int(w.free[i])
            kind, s, e = KINDS.index(name[2:]), int(w.starts[word]), int(w.ends[word])
            mine = proposals.setdefault(r, [])
            if name[0] == "I" and mine:
                mine[-1] = (mine[-1][0], kind, e)
            else:
                mine.append((s, kind, e))
        signs = np.concatenate(([0], np.cumsum(_SIGN[raw])))
        marked = signs[offsets[1:]] > signs[offsets[:-1]]
        for r in range(b - a):
            if not marked[r] and r not in proposals:
                out.append(([], []))
                continue
            data = raw[offsets[r]: offsets[r + 1]].tobytes()
            base = base_spans(data.decode("utf-8", "replace"))
            every = list(base)
            mine = proposals.get(r, ())
            if mine:
                # code points before each byte, and the furthest end of the base spans up to each one, by start
                points = np.concatenate(([0], np.cumsum((raw[offsets[r]: offsets[r + 1]] & 0xC0) != 0x80)))
                base_starts, reach = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
            free = 0
            for s, kind, e in mine:
                value = data[s - offsets[r]: e - offsets[r]].decode("utf-8", "replace")
                lead = len(value) - len(value.lstrip("\"'<[{," if kind == 3 else "\"'<[{(,"))
                cut = value[lead:].rstrip(".,;:!?\"'>]}" + ("" if kind == 3 and "(" in value or kind == 0 and "(" in value else ")"))
                start = int(points[s - offsets[r]]) + lead
                end = start + len(cut)
                before = bisect_left(base_starts, end)
                if _fits(kind, cut) and free <= start and not (before and reach[before - 1] > start):
                    every.append((start, kind, end))
                    free = end
            out.append((base, sorted(every)))
    return out


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans.

    Counts are of all spans, ``n_added`` of those that the field adds; added spans do not overlap others. Spans are
    ``kind:start:end`` in code points, end exclusive, by start and kind, joined by commas. A null text counts as empty: no spans, the digest of
    the empty string. Repeated rows give repeated results; other columns are not read.
    """
    field = field or fit()

    def found(column: pa.Array) -> pa.Array:
        rows = _spans(field, column)
        counts = [pa.array([sum(k == kind for _, k, _ in every) for _, every in rows], pa.int64()) for kind in range(len(KINDS))]
        return pa.StructArray.from_arrays([
            *counts, pa.array([len(every) - len(base) for base, every in rows], pa.int64()),
            pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows], pa.string()), pa.array([_joined(every) for _, every in rows], pa.string()),
        ], names=["n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"])

    column = F.arrow_udf(found, "n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")
    return docs.select(F.col(id_col).alias("doc_id"), column(F.col(text_col)).alias("f")).select("doc_id", "f.*")
