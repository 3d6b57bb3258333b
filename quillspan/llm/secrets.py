"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens decoded by Viterbi.

Tokens are tagged O, B or I from their shape, the words and marks around them and features of the whole text. The field
is trained on the driver from a small synthetic set of labelled lines with a fixed seed; no corpus data enters it.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_kind, map_texts, span_text, table

KINDS = ("assign", "access", "hex", "crf")
BASE_KINDS = KINDS[:3]
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: One of these is in the lower-cased text wherever _ASSIGN matches.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- tokens and features

_SPACE, _LOWER, _UPPER, _DIGIT, _INNER, _MARK, _WIDE = range(7)
_CLASS = np.full(129, _MARK, np.uint8)
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = _SPACE if _c.isspace() or _i < 32 else _LOWER if _c.islower() else _UPPER if _c.isupper() else _DIGIT if _c.isdigit() else _INNER if _c in "_-./+~" else _MARK
_CLASS[128] = _WIDE
#: Five counters of 12 bits in one number, so that one running sum counts them all: digits, upper case, inner marks, other scripts, a-f.
_FIELD = 12
_PACK = np.zeros(129, np.uint64)
for _i in range(129):
    _k = {_DIGIT: 0, _UPPER: 1, _INNER: 2, _WIDE: 3}.get(int(_CLASS[_i]))
    _PACK[_i] = (0 if _k is None else 1 << (_k * _FIELD)) + (97 <= _i <= 102) * (1 << (4 * _FIELD))

# Words that announce a credential, and starts of well-known key formats.
_CREDENTIAL = ("password", "passwd", "pwd", "pass", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "key", "access_key", "secret_key", "access-key",
               "private_key", "client_secret", "auth", "authorization", "bearer", "basic", "credential", "credentials", "passwort", "kennwort", "contraseña", "clave",
               "login", "pin", "x-api-key", "auth_token", "access_token", "refresh_token", "db_password", "signature")
_PREFIXES = ("ghp_", "gho_", "sk-", "sk_l", "pk_l", "xoxb", "xoxp", "AIza", "glpa", "ya29", "eyJh", "npm_", "SG.", "AKIA")
_KEYWORDS = frozenset(_CREDENTIAL)
_LONGEST = max(map(len, _CREDENTIAL))
#: What a keyword ends with, at least.
_ENDINGS = tuple(w for w in _CREDENTIAL if not any(w != v and w.endswith(v) for v in _CREDENTIAL))

#: Kinds of tokens. The plain ones are what prose is made of.
_OTHER, _NUMBER, _HEXA, _ALNUM, _JOINED, _CAMEL, _COMPOUND, _ALPHA, _SINGLE = range(9)
_LENGTHS = (1, 4, 8, 12, 16, 20, 32)
_PLAIN = (_OTHER, _COMPOUND, _ALPHA, _SINGLE)
_N_SHAPE = 9 * len(_LENGTHS)
_BIAS = _N_SHAPE
_MIX0 = _BIAS + 1  # changes of class: 4 steps
_KW0 = _MIX0 + 4  # keyword 1..5 tokens before, for tokens that aren't plain
_MARKS0 = _KW0 + 5  # before: = or :, quote, @, bar or bracket; after: quote, @
_NEAR0 = _MARKS0 + 6  # a keyword stands near and, if not next, = or : between: plain, number, other
_PREFIX, _FILE_KEY, _FILE_CODE, _ADDRESS = range(_NEAR0 + 3, _NEAR0 + 7)
N_FEATURES = _ADDRESS + 1
WIDTH = 15


class Tokens(NamedTuple):
    text: str
    small: np.ndarray
    start: np.ndarray  # code points of the joined text
    end: np.ndarray
    line: np.ndarray  # lines are sequences
    shape: np.ndarray  # kind and length
    offsets: np.ndarray  # where each text starts


def tokenize(texts: list[str]) -> Tokens:
    """Tokens of texts joined by line ends: runs of letters, digits and inner marks, and single other marks."""
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(code, 128).astype(np.uint8)
    cls = _CLASS[small]
    mark = cls == _MARK
    run = (cls != _SPACE) & ~mark
    edge = run[1:] != run[:-1]
    first = np.flatnonzero(edge & run[1:]) + 1
    if run[0]:
        first = np.concatenate([[0], first])
    last = np.flatnonzero(edge & run[:-1]) + 1
    single = np.flatnonzero(mark)
    start, end = np.concatenate([first, single]), np.concatenate([last, single + 1])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_PACK[small], dtype=np.uint64)])
    packed = sums[end] - sums[start]
    digits, upper, inner, wide, hexa = ((packed >> np.uint64(k * _FIELD)).astype(np.int32) & ((1 << _FIELD) - 1) for k in range(5))
    length = end - start
    kind = np.full(len(start), _ALPHA, np.int8)
    kind[inner > 0] = _COMPOUND
    kind[(upper > 1) & (upper < length) & (inner == 0)] = _CAMEL
    kind[digits > 0] = _JOINED
    kind[(digits > 0) & (inner == 0)] = _ALNUM
    kind[(digits > 0) & (hexa + digits == length)] = _HEXA
    kind[digits == length] = _NUMBER
    kind[wide > 0] = _OTHER
    kind[mark[start]] = _SINGLE
    size = np.searchsorted(_LENGTHS, length, side="right") - 1
    lines = np.flatnonzero(code == 10)
    return Tokens(joined, small, start, end, np.searchsorted(lines, start), kind * len(_LENGTHS) + size, offsets)


@lru_cache(maxsize=1 << 16)
def is_keyword(word: str) -> bool:
    """A word for a credential, or a name that ends with one."""
    return re.split("[_.-]", word.lower())[-1] in _KEYWORDS


def after_keywords(t: Tokens) -> np.ndarray:
    """Flags of the tokens with a keyword among the five before them, and of some others: a token that ends as one does counts."""
    low = t.small.tobytes().lower()  # a byte for each code point, 128 for all beyond ASCII
    if "\u212a" in t.text:  # the only other letter of which the lower case is in a keyword
        low = bytes(ord("k") if c == "\u212a" else b for c, b in zip(t.text, low, strict=True))
    ends = []
    for word in _ENDINGS:
        sought, at = bytes(min(ord(c), 128) for c in word), -1
        while (at := low.find(sought, at + 1)) >= 0:
            ends.append(at + len(sought))
    out = np.zeros(len(t.start) + 6, bool)
    if ends:
        end = np.unique(ends)
        token = np.searchsorted(t.end, end)
        token = token[(token < len(t.end)) & (t.end[np.minimum(token, len(t.end) - 1)] == end)]
        for d in range(1, 6):
            out[token + d] = True
    return out[: len(t.start)]


def features_of(t: Tokens, at: np.ndarray) -> np.ndarray:
    """The active features of the tokens at the given places: one of each group or -1, in WIDTH columns."""
    n, out = len(at), np.full((len(at), WIDTH), -1, np.int16)
    shape = t.shape[at]
    kind = shape // len(_LENGTHS)
    plain = np.isin(kind, _PLAIN)
    out[:, 0], out[:, 1] = shape, _BIAS
    start, end, line = t.start[at], t.end[at], t.line[at]
    char = lambda j: np.where(t.shape[j] // len(_LENGTHS) == _SINGLE, t.small[t.start[j]], 0)
    distance, assigned, near = np.zeros(n, np.int8), np.zeros(n, bool), np.zeros(n, bool)
    for d in range(1, 6):
        j = np.maximum(at - d, 0)
        same = (at >= d) & (t.line[j] == line)
        prev = np.where(same, char(j), 0)
        assigned |= (prev == 61) | (prev == 58)
        short = same & (distance == 0) & (prev == 0) & (t.end[j] - t.start[j] <= _LONGEST)
        hit = np.zeros(n, bool)
        for i in np.flatnonzero(short):
            hit[i] = is_keyword(t.text[t.start[j[i]] : t.end[j[i]]])
        distance[hit] = d
        near |= hit & (assigned | (d <= 2))
        if d == 1:
            before = prev
    k = np.minimum(at + 1, len(t.start) - 1)
    after = np.where((at + 1 < len(t.start)) & (t.line[k] == line), char(k), 0)
    strong = ~plain
    out[:, 2] = np.where(near, _NEAR0 + np.where(plain, 0, np.where(kind == _NUMBER, 1, 2)), -1)
    out[:, 3] = np.where(strong & (distance > 0), _KW0 + distance - 1, -1)
    for i, on in enumerate(((before == 61) | (before == 58), (before == 34) | (before == 39), before == 64, (before == 124) | (before == 40), (after == 34) | (after == 39), after == 64)):
        out[:, 4 + i] = np.where(strong & on, _MARKS0 + i, -1)
    text = np.searchsorted(t.offsets, start, side="right") - 1
    file_key, file_code = {}, {}
    for i in np.unique(text):
        whole = t.text[t.offsets[i] : t.offsets[i + 1]]
        low = whole.lower()
        file_key[i] = any(w in low for w in ("passw", "secret", "token", "key", "auth"))
        file_code[i] = whole.count("=") + whole.count("{") + whole.count("}") + whole.count(";") > 0.004 * len(whole)
    for i in np.flatnonzero(strong):
        word = t.text[start[i] : end[i]]
        out[i, 10] = _MIX0 + min(3, int(np.count_nonzero(np.diff(_CLASS[t.small[start[i] : end[i]]]))) // 2)
        out[i, 11] = _PREFIX if len(word) > 12 and word.startswith(_PREFIXES) else -1
        out[i, 12] = _FILE_KEY if file_key[text[i]] else -1
        out[i, 13] = _FILE_CODE if file_code[text[i]] else -1
        out[i, 14] = _ADDRESS if word.startswith("//") else -1
    return out


# ---- the field

O, B, I = range(3)  # noqa: E741


class Field(NamedTuple):
    emission: np.ndarray  # N_FEATURES x 3
    transition: np.ndarray  # 3 x 3


def emissions(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    padded = np.vstack([weights, np.zeros(weights.shape[1])])  # -1: no feature
    return padded[features].sum(1)


def viterbi(e: np.ndarray, transition: np.ndarray, left: int | None, right: int | None) -> list[int]:
    """The best tags of a chain; left and right: the known tags around it, if any."""
    score = e[0] + (transition[left] if left is not None else 0)
    back = []
    for row in e[1:]:
        step = score[:, None] + transition
        back.append(step.argmax(0))
        score = step.max(0) + row
    if right is not None:
        score = score + transition[:, right]
    tags = [int(score.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def open_shapes(field: Field) -> tuple[np.ndarray, np.ndarray]:
    """For each shape: the most that a tag other than O can lead by, whatever stands around the token, if no keyword is
    near, and if one is."""
    lead = np.maximum(field.emission[:, B], field.emission[:, I]) - field.emission[:, O]
    most = lambda a, b: max(0.0, lead[a:b].max())
    marks = sum(most(_MARKS0 + i, _MARKS0 + i + 1) for i in range(6))
    strong = marks + most(_MIX0, _MIX0 + 4) + sum(most(i, i + 1) for i in (_PREFIX, _FILE_KEY, _FILE_CODE, _ADDRESS))
    plain = np.isin(np.arange(_N_SHAPE) // len(_LENGTHS), _PLAIN)
    far = lead[:_N_SHAPE] + lead[_BIAS] + np.where(plain, 0.0, strong)
    return far, far + np.where(plain, most(_NEAR0, _NEAR0 + 1), most(_NEAR0 + 1, _NEAR0 + 3) + most(_KW0, _KW0 + 5))


def decode(t: Tokens, field: Field) -> np.ndarray:
    """Viterbi tags of all tokens, line by line; only stretches that can hold a secret are decoded, without loss.

    Let g be the most that a transition gains over O to O, and a token's cost be O's lead over B and I, less g. A stretch
    of B and I whose tokens all have a positive cost loses against O, so each stretch has a seed, a token without. Going
    out from a seed, once the costs add up to more than slack, which bounds what the transitions at a cut can make
    good, putting O there is better. So the best path is O outside of the windows that end there.
    """
    n = len(t.start)
    tags = np.zeros(n, np.int8)
    tr = field.transition
    gains = tr - tr[O, O]
    gains[O, O] = 0
    g = max(0.0, gains.max())
    out, into = tr[1:, O], tr[O, 1:]
    slack = max(g + 2 * tr[O, O] - out.min() - into.min(), out.max() - out.min(), into.max() - into.min(), 0.0)
    e = np.zeros((n, 3))
    known = np.zeros(n, bool)

    def score(at: np.ndarray) -> np.ndarray:
        new = at[~known[at]]
        if len(new):
            e[new], known[new] = emissions(features_of(t, new), field.emission), True
        return e[at]

    far, near = open_shapes(field)
    seeds = np.flatnonzero(np.where(after_keywords(t), near[t.shape], far[t.shape]) + g >= 0)
    if not len(seeds):
        return tags
    x = score(seeds)
    seeds = seeds[x[:, 1:].max(1) - x[:, O] + g >= 0]
    inside = np.zeros(n, bool)
    inside[seeds] = True
    for step in (1, -1):
        at, spent = seeds, np.zeros(len(seeds))
        while len(at):
            nxt = at + step
            ok = (nxt >= 0) & (nxt < n)
            at, nxt, spent = at[ok], nxt[ok], spent[ok]
            ok = t.line[nxt] == t.line[at]
            at, spent = nxt[ok], spent[ok]
            if not len(at):
                break
            x = score(np.unique(at))
            inside[at] = True
            spent = spent + e[at, O] - e[at, 1:].max(1) - g
            at, spent = at[spent <= slack], spent[spent <= slack]
    at = np.flatnonzero(inside)
    if not len(at):
        return tags
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(t.line[at]) > 0)) + 1
    for part in np.split(at, cuts):
        a, b = part[0], part[-1]
        left = O if a > 0 and t.line[a - 1] == t.line[a] else None
        right = O if b + 1 < n and t.line[b + 1] == t.line[b] else None
        tags[part] = viterbi(e[part], tr, left, right)
    return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def fit(texts: list[str], spans: list[tuple[int, int] | None], rounds: int = 150, rate: float = 0.2, l2: float = 0.0005) -> Field:
    """Maximum likelihood with Adam; each text is one line with at most one labelled span."""
    tokens = tokenize(texts)
    offsets, features = tokens.offsets, features_of(tokens, np.arange(len(tokens.start)))
    text = np.searchsorted(offsets, tokens.start, side="right") - 1
    active = np.zeros((len(text), N_FEATURES + 1))
    for column in features.T:
        active[np.arange(len(text)), column] += 1
    active = active[:, :-1]
    gold = np.zeros(len(text), np.int64)
    for i, span in enumerate(spans):
        if span:
            inside = np.flatnonzero((text == i) & (tokens.start < offsets[i] + span[1]) & (tokens.end > offsets[i] + span[0]))
            gold[inside] = I
            gold[inside[:1]] = B
    n = len(texts)
    sizes = np.bincount(text, minlength=n)
    place = np.arange(len(text)) - np.concatenate([[0], np.cumsum(sizes)])[text]
    longest = sizes.max()
    live = np.arange(longest)[None] < sizes[:, None]
    w, t = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    params, m, v = [w, t], [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    observed = np.zeros((3, 3))
    np.add.at(observed, (gold[:-1][text[1:] == text[:-1]], gold[1:][text[1:] == text[:-1]]), 1)
    for r in range(1, rounds + 1):
        e = np.zeros((n, longest, 3))
        e[text, place] = active @ w
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for k in range(1, longest):
            step = _logsum(f[:, k - 1, :, None] + t[None], 1) + e[:, k]
            f[:, k] = np.where(live[:, k, None], step, f[:, k - 1])
        z = _logsum(f[:, -1], 1)
        expected = np.zeros((3, 3))
        for k in range(longest - 2, -1, -1):
            nxt = np.where(live[:, k + 1, None], e[:, k + 1] + b[:, k + 1], 0)
            step = _logsum(t[None] + nxt[:, None, :], 2)
            b[:, k] = np.where(live[:, k + 1, None], step, 0)
            pair = np.exp(f[:, k, :, None] + t[None] + nxt[:, None, :] - z[:, None, None])
            expected += pair[live[:, k + 1]].sum(0)
        p = np.exp(f + b - z[:, None, None])[text, place]
        diff = np.eye(3)[gold] - p
        for q, g in zip(range(2), (active.T @ diff / n - l2 * w, (observed - expected) / n - l2 * t), strict=True):
            m[q], v[q] = 0.9 * m[q] + 0.1 * g, 0.999 * v[q] + 0.001 * g * g
            params[q] += rate * (m[q] / (1 - 0.9**r)) / (np.sqrt(v[q] / (1 - 0.999**r)) + 1e-8)
    return Field(w, t)


def training_lines(n: int = 1200, seed: int = 7) -> tuple[list[str], list[tuple[int, int] | None]]:
    """Synthetic labelled lines: half hold one secret, half hold what resembles one."""
    r = np.random.default_rng(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def draw(alphabet: str, a: int, b: int) -> str:
        return "".join(alphabet[i] for i in r.integers(0, len(alphabet), r.integers(a, b)))

    def pick(*options: str) -> str:
        return options[r.integers(0, len(options))]

    def word() -> str:
        w = "".join(pick("th", "er", "on", "an", "re", "in", "ed", "st", "ou", "ing", "ion", "ß", "é", "ch", "eau", "ción", "keit") for _ in range(r.integers(1, 5)))
        return pick(w, w, w, w.capitalize(), w + ",", w + ".")

    def prose(a: int, b: int) -> str:
        return " ".join(word() for _ in range(r.integers(a, b)))

    secrets = (
        lambda: draw(low + up + dig, 16, 44), lambda: draw(low + up + dig + "+/", 30, 60), lambda: draw(low + up + dig + "-_", 20, 45),
        lambda: pick("ghp_", "gho_", "npm_", "sk_live_", "pk_live_", "sk-", "glpat-") + draw(low + up + dig, 20, 40), lambda: "xoxb-" + draw(dig, 10, 12) + "-" + draw(low + up + dig, 20, 26),
        lambda: "AIza" + draw(low + up + dig + "-_", 34, 36), lambda: "eyJhbGciOi" + draw(low + up + dig, 12, 24) + "." + draw(low + up + dig + "-_", 30, 60) + "." + draw(low + up + dig + "-_", 30, 44),
    )
    weak = (lambda: draw(low + up + dig, 8, 14), lambda: draw(low, 4, 7) + draw(dig, 2, 5) + pick("!", "#", "$", "") + draw(low + up, 0, 4), lambda: pick("Winter", "Summer", "hunter", "dragon") + draw(dig, 2, 5) + pick("!", ""))
    decoys = (
        lambda: draw(dig, 12, 17), lambda: f"+1 ({draw(dig, 3, 4)}) 555-{draw(dig, 4, 5)}", lambda: f"{draw(low, 2, 9)}{draw(dig, 1, 3)}@mail{draw(dig, 1, 2)}.example.com",
        lambda: ".".join(str(x) for x in r.integers(0, 256, 4)), lambda: f"{r.integers(1990, 2030)}-{r.integers(10, 13)}-{r.integers(10, 29)}", lambda: "https://www." + draw(low, 4, 12) + ".org/" + draw(low, 3, 9) + "/" + draw(low + "-", 5, 20),
        lambda: "/".join(draw(low, 3, 9) for _ in range(3)) + ".py", lambda: draw(low, 4, 8) + draw(low, 3, 9).capitalize() + draw(low, 3, 9).capitalize(), lambda: draw(low, 18, 36),
        lambda: "v" + ".".join(str(x) for x in r.integers(0, 30, 3)), lambda: draw(low, 4, 9) + pick("***", "%%%", "&&&", "$$$"), lambda: "| " + draw(low, 3, 8) + " |",
        lambda: "-".join(draw(dig, 1, 8) for _ in range(r.integers(3, 6))), lambda: "https://" + draw(low, 4, 9) + ".net/" + draw(low + dig, 2, 6) + "/" + pick("v", "p", "s") + draw(dig, 1, 4) + "/" + draw(low + "-", 5, 20) + pick(".html", ""),
        lambda: f"{r.integers(0, 12)}.{r.integers(0, 40)}.{r.integers(0, 20)}" + pick("-", "", ".") + pick("rc", "beta", "b", "dev", "post") + draw(dig, 1, 3), lambda: draw("0123456789abcdef", 7, 12),
        lambda: pick("password", "token", "secret", "key") + " " + prose(1, 4), lambda: pick("Passwort", "token", "key", "pin") + ": " + pick("see", "none", "required", "ask", "in") + " " + prose(1, 3), lambda: draw(up, 2, 8),
    )
    texts, spans = [], []
    for i in range(n):
        left, right = prose(0, 6), prose(0, 6)
        if i % 2:
            strong = r.random() < 0.65
            s = (secrets if strong else weak)[r.integers(0, len(secrets if strong else weak))]()
            name = pick(*_CREDENTIAL)
            name = pick(name, name.upper(), name.capitalize())
            q = pick("", '"', "'")
            lead = pick(f"{name} = {q}", f"{name}: {q}", f"{name}={q}", f"{q}{name}{q}: {q}", f"{name} {q}", f"{name} is {q}", f"export {name}={q}", "Authorization: Bearer ", f"{name} : {q}")
            if strong and r.random() < 0.25:
                lead = q
            end = q if lead.endswith(q) else ""
            if r.random() < 0.12:  # in an address
                lead, end = f"{pick('https', 'ftp', 'redis', 'amqp')}://{draw(low, 2, 8)}:", f"@{draw(low, 3, 8)}.{pick('com', 'io', 'net')}{pick('', '/', ':80/' + draw(low, 2, 6))}"
            lead = f"{left} {lead}".lstrip()
            texts.append(f"{lead}{s}{end} {right}".rstrip())
            spans.append((len(lead), len(lead) + len(s)))
        else:
            middle = decoys[r.integers(0, len(decoys))]() if r.random() < 0.8 else ""
            texts.append(f"{left} {middle} {right}".strip() or "a")
            spans.append(None)
    return texts, spans


@lru_cache(maxsize=1)
def trained() -> Field:
    return fit(*training_lines())


MIN_SECRET = 8


def crf_spans(texts: list[str], field: Field, base: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """Spans of tagged tokens of each text that overlap no base span: first B or I up to the last I, with padding."""
    tokens = tokenize(texts)
    offsets, tags = tokens.offsets, decode(tokens, field)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    on = np.flatnonzero(tags != O)
    if not len(on):
        return out
    starts = np.concatenate([[True], (np.diff(on) > 1) | (tags[on[1:]] == B) | (np.diff(tokens.line[on]) > 0)])
    for part in np.split(on, np.flatnonzero(starts)[1:]):
        i = int(np.searchsorted(offsets, tokens.start[part[0]], side="right") - 1)
        a, b = int(tokens.start[part[0]] - offsets[i]), int(tokens.end[part[-1]] - offsets[i])
        while b < len(texts[i]) and texts[i][b] == "=":
            b += 1
        if b - a >= MIN_SECRET and not any(s < b and a < e for s, e, _ in base[i]):
            out[i].append((a, b, "crf"))
    return out


SCHEMA = "array<struct<start: int, end: int, kind: string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def find_secrets(docs: DataFrame, text: str = "text", to: str = "secrets", keep: list[str] | None = None, field: Field | None = None) -> DataFrame:
    """docs with the spans of secrets in a text column: (start, end, kind), code points, end exclusive, by start.

    The fixed patterns' spans always stay; kind crf marks what the field adds. A null or empty text has none. Rows are
    looked at one by one: repeated rows get equal spans, and the features of a file are those of its own text. A column
    of the name of the result gives way; keep names the columns to return, all by default. An empty table gives an
    empty one.
    """
    model = field or trained()

    def scan(texts: list[str]) -> list[pa.Array]:
        base = [base_spans(t) for t in texts]
        spans = [sorted(b + c, key=lambda s: (s[0], KINDS.index(s[2]))) for b, c in zip(base, crf_spans(texts, model, base), strict=True)]
        return [pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in r] for r in spans], _SPANS)]

    return map_texts(docs, scan, {to: (SCHEMA, _SPANS)}, text, keep, 1 << 20)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its counts of the fixed patterns, and all spans. Edge cases as in find_secrets."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [count_kind(F.col("secrets"), k).alias(f"n_{k}") for k in BASE_KINDS]
    base = span_text(F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS)))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"))
