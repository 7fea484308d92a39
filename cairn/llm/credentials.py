"""Credentials embedded in source code and configuration: find and redact.

1. Candidates are string literals, assigned or described values, user parts of URLs, passwords of connection strings,
   header values and private key blocks; pieces of a literal joined over several lines count as one value.
2. Every candidate gets features: its character likelihood under a Markov chain of ordinary literals and names against one
   of random strings, its shape, the words of the surrounding identifier, where it stands, and the path.
3. A logistic regression is fitted on weak labels: values of well-known token formats and random values under telling names
   are positive; placeholders, references, digests, identifiers and ordinary words are negative; the rest is left to the model.
4. Scores are calibrated (isotonic steps) with the weights learned without the value's own fold, so that every labelled value
   takes part in both, and values from ``THRESHOLD`` on are replaced by ``REDACTED`` - only the characters of the credential
   itself, so quotes, names and the rest of the URL stay.

Nothing is sampled: the words of the Markov chain, the weights and the steps come from all rows, whole texts and values of any
length, with or without spaces. Texts are read once, their candidates and the features of these are written to the checkpoint
folder; a step of the regression (Newton's method) is a pass over the features that gives sums of fixed size, and the steps
are pooled within sorted ranges before the ends of the ranges meet. Weights start at nothing and are learned from the weak
labels and from drawn values, which weigh the same beside few rows and many.

Defined cases: null and empty texts have no candidates; repeated rows of an id come out once in ``found``; tables
without positives or negatives fall back to fixed weights.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.session import ensure_checkpoint_dir

REDACTED = "[REDACTED]"
THRESHOLD = 0.5
#: What all words together weigh against the smoothing of the Markov chain, where there are as many.
WORDS_WEIGHT = 40_000
#: What all drawn values together weigh at least, beside the labelled ones.
DRAWN_SHARE = 0.1
FOLDS = 5
RIDGE = 0.0002

#: Words of names that tell of credentials, of settings about them, and of other random-looking values.
SECRET_WORDS = set("password passwd pwd pass passphrase secret token apikey credential credentials auth authorization jwt bearer salt key hmac signing access refresh private login connection conn dsn pw pin cookie stripe".split())
STRONG_WORDS = set("password passwd pwd pw pass passphrase secret token apikey credential credentials jwt bearer salt hmac hmacsecret signing login".split())
BENIGN_WORDS = set("min max length len size limit count field header name public algorithm ttl expiry expires path file url endpoint type prefix suffix policy rotation id label hint format version enabled timeout days".split())
DIGEST_WORDS = set("sha sha1 sha256 sha384 checksum digest etag commit hash integrity trace request tenant uuid guid logo image build revision rev fingerprint nonce md5 crc session correlation".split())

_KNOWN = re.compile(r"sk_(?:live|test)_[A-Za-z0-9]{10,}|gh[opsur]_[A-Za-z0-9]{14,}|xox[abprs]-[A-Za-z0-9-]{10,}|AKIA[A-Z0-9]{12,}|ASIA[A-Z0-9]{12,}|AIza[\w-]{20,}|glpat-[\w-]{12,}|npm_[A-Za-z0-9]{20,}|SG\.[\w-]{10,}\.[\w-]{10,}|ey[JK][\w-]{8,}\.[\w-]{8,}(?:\.[\w-]{4,})?|[a-z]{3,6}_[A-Za-z0-9]{26,}")
_PLACE = re.compile(
    r"(?i)^(?:x+|\*+|\.+|-+|0+|#+|<[^>]*>|\$\{?[\w.]+\}?.*|%\(?\w+\)?s?%?|\{\{.*\}\}|\{[\w.]*\}|\[[\w .-]*\]|__\w+__|none|null|nil|true|false|todo.*|fixme|tbd|n/?a|changeme|change[-_ ]?(?:me|it|this)|example|sample|dummy|fake|test|secret|password|passwd|token|default|redacted|\[?redacted\]?|insert.*|enter.*|replace.*|your[-_ ].*|my[-_ ]?(?:password|secret|token|key)|.*[-_ ](?:here|placeholder)|placeholder|process\.env.*|os\.environ.*|env\(.*|vault:?/.*|ref\+.*|arn:.*|file:.*)$"
)
_REPEAT = re.compile(r"(?i)([x*#.0-])\1{5,}|<[\w -]+>|\$\{|\$\(|%\(|\{\{|(?:12345|abcde)")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----((?:(?:[\s\"'`+,.;\\/*#-]|\\[nr])*[A-Za-z0-9+/=]{16,})+)")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
_QUOTED = r"(?:\"(?P<d>(?:[^\"\\\n]|\\.)*+)\"|'(?P<s>(?:[^'\\\n]|\\.)*+)'|`(?P<b>[^`\n$]*+)`)"
_LITERAL = re.compile(_QUOTED)
_SEAM = re.compile(r"([\"'])[ \t]*(?:\+[ \t]*(?:\r?\n[ \t]*)?|\r?\n[ \t]*(?:[+.][ \t]*)?|\\\r?\n[ \t]*)\1(?!\1)")
_OPTION = re.compile(r"--?(?P<n>pass(?:word|wd)?|token|secret|api-?key|auth)[= ][\"']?(?P<v>[^\s\"']{6,})")
_INSIDE = re.compile(r"password|passwd|passphrase|secret|token|apikey|credential|jwt|hmac|pass$|pwd$|pw$|key$|salt$|auth$|conn$")
_BARE = re.compile(r"(?<![\w.-])(?P<n>[A-Za-z_][\w.-]*+)[ \t]*(?:=|:|[ ]is[ ]|[ ]was[ ]|->)[ \t]*(?![\w.-]+[ \t]*(?:[:=][ \t]|->|[ ](?:is|was)[ ]))(?P<v>[^\s\"'`,;(){}\[\]<>]{6,})")
_URL = re.compile(r"\b[a-zA-Z][\w+.-]{1,20}://(?P<u>[^\s:/@\"'`<>]*):(?P<v>[^\s@/\"'`]+)@(?P<h>[\w.-]+)")
_CONN = re.compile(r"(?i)\b(?:password|pwd|accountkey|sharedaccesskey)=(?P<v>[^;\"'`\s]{4,})")
_HEADER = re.compile(r"\b(?:Bearer|Basic|Token|bearer|basic|token)[ ]+(?P<v>[A-Za-z0-9+/=._~-]{10,})")
#: Read from right to left: prefix, call, opening bracket, sign, type, closing marks, name.
_BEFORE = re.compile(r"[rbfuRBFU@$]{0,2}(?:\(\w+ wen)?(?:\s*(?:[(\[][ \t]*)?(?:=:|>=|==|=|:|\(|\[|si[ ]|ro[ ]|\?\?|\|\|)[ \t]*|[ \t]*,[ \t]*)(?:[\w<>\[\]?. ]{1,40}?[ \t]*:)?[ \t]*[\"'\])]*([\w$.-]*[A-Za-z_$])")
_SQL = re.compile(r"(?i)\s*(?:YB(?:\s+\w+\s+HTIW)?\s+DEIFITNEDI|DROWSSAP)\b")
_AFTER = re.compile(r"^[\"'`]?[;,)\]} \t]*(?://|#|--|/\*)[ \t]*([\w-]+)")
_WORD = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")


@dataclass
class Candidate:
    spans: list[tuple[int, int]]
    value: str
    name: str
    kind: str  # literal, bare, url, conn, header, known, pem


def name_words(name: str) -> list[str]:
    """Words of an identifier in lower case; run-together ones like accesstoken give their telling part, too."""
    out = [w.lower() for w in _WORD.findall(name)]
    for w in out[:]:
        m = _INSIDE.search(w)
        if m and m[0] != w:
            out.append(m[0])
    return out


def joined(text: str) -> tuple[str, list[int] | None]:
    """The text with the seams of concatenated literals taken out, and the place of each character (None: unchanged)."""
    parts, at, last = [], [], 0
    for m in _SEAM.finditer(text):
        parts.append(text[last : m.start()])
        at.extend(range(last, m.start()))
        last = m.end()
    if not parts:
        return text, None
    parts.append(text[last:])
    at.extend(range(last, len(text) + 1))
    return "".join(parts), at


def candidates(text: str, given_name: str = "") -> list[Candidate]:
    """Values that could be credentials. ``given_name`` names a text that is one value as a whole."""
    text, places = joined(text)
    out: list[Candidate] = []
    taken = bytearray(len(text))

    def original(a: int, b: int) -> list[tuple[int, int]]:
        if places is None:
            return [(a, b)]
        spans, start = [], a
        for k in range(a + 1, b):
            if places[k] != places[k - 1] + 1:
                spans.append((places[start], places[k - 1] + 1))
                start = k
        return [*spans, (places[start], places[b - 1] + 1)]

    def free(a: int, b: int) -> bool:
        return taken.find(1, a, b) < 0

    def add(spans, name, kind):
        if all(free(a, b) for a, b in spans):
            for a, b in spans:
                taken[a:b] = b"\1" * (b - a)
            out.append(Candidate([o for a, b in spans for o in original(a, b)], "".join(text[a:b] for a, b in spans), name, kind))

    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            spans = [(m.start(1) + p.start(), m.start(1) + p.end()) for p in _PEM_BODY.finditer(m[1])]
            if spans:
                add(spans, "", "pem")
            taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    if "://" in text:
        for m in _URL.finditer(text):
            add([m.span("v")], "", "url")
            taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    for m in _CONN.finditer(text):
        add([m.span("v")], "", "conn")
    for m in _HEADER.finditer(text):
        add([m.span("v")], "", "header")
    for m in _KNOWN.finditer(text):
        a, b = m.span()
        if (a and (text[a - 1].isalnum() or text[a - 1] in "_+/")) or (b < len(text) and (text[b].isalnum() or text[b] in "+/(")):
            continue
        add([(a, b)], "", "known")
    if given_name:
        if free(0, len(text)) and not out:
            add([(0, len(text))], given_name, "literal")
        return out
    for m in _LITERAL.finditer(text):
        g = "d" if m["d"] is not None else "s" if m["s"] is not None else "b"
        a, b = m.span(g)
        if b - a < 4:  # matched all the same: its closing mark opens nothing
            continue
        name = _before(text, m.start())
        if name.lower() in ("", "arg", "val", "value", "v", "x", "default", "none", "null"):
            t = _AFTER.match(text[b : b + 60])
            name = t[1] if t else name
        add([(a, b)], name, "literal")
    for m in _BARE.finditer(text):
        if _relevant(m["n"]):
            add([m.span("v")], m["n"], "bare")
    for m in _OPTION.finditer(text):
        add([m.span("v")], m["n"], "bare")
    return out


def _before(text: str, at: int) -> str:
    """The identifier a value is given to, to the left of ``at``."""
    back = text[max(0, at - 200) : at][::-1]
    m = _BEFORE.match(back)
    if m and len(m[1]) < 200 - m.start(1) - 1:
        name = m[1][::-1].lstrip("-.")
        if name and not name[0].isdigit():
            return name
    return "password" if _SQL.match(back) else ""


def _relevant(name: str) -> bool:
    return not SECRET_WORDS.isdisjoint(name_words(name))


class Markov:
    """Log likelihood per character of a string, order 2 with fallback, over printable ASCII."""

    def __init__(self):
        self.table = np.full((96, 96), 0.1)

    @staticmethod
    def _codes(x: str) -> list[int]:
        return [min(max(ord(c) - 32, 0), 95) for c in x]

    def learn(self, texts):
        for x in texts:
            c = self._codes(f" {x} ")
            np.add.at(self.table, (c[:-1], c[1:]), 1)
        return self

    def add(self, pairs: np.ndarray):
        """Counts of pairs as ``WordPairs`` gives them."""
        self.table += pairs[:-1].reshape(96, 96) * min(1.0, WORDS_WEIGHT / max(pairs[-1], 1.0))
        return self

    def done(self):
        self.log = np.log(self.table / self.table.sum(axis=1, keepdims=True))
        self.rows = self.log.tolist()
        return self

    def score(self, x: str) -> float:
        c = self._codes(f" {x} ")
        rows = self.rows
        return sum(rows[p][q] for p, q in zip(c, c[1:])) / (len(c) - 1)


def entropy(x: str) -> float:
    n = len(x)
    return -sum(k / n * math.log2(k / n) for k in Counter(x).values()) if n else 0.0


def _random(x: str) -> bool:
    """Letters and digits without the makings of words."""
    classes = sum((any(c.islower() for c in x), any(c.isupper() for c in x), any(c.isdigit() for c in x)))
    longest = max((len(w) for w in re.findall(r"[a-z]+|[A-Z][a-z]*", x)), default=0)
    return len(x) >= 8 and entropy(x) > 2.8 and (classes == 3 or (classes == 2 and any(c.isdigit() for c in x))) and longest <= max(6, len(x) // 4)


def placeholder(v: str) -> bool:
    return bool(_PLACE.match(v) or _REPEAT.search(v)) or len(set(v)) <= 3


def digestlike(v: str) -> bool:
    return bool(_UUID.fullmatch(v)) or v.startswith(("sha1-", "sha256-", "sha384-", "sha512-", "data:", "ssh-", "sha256:", "urn:")) or (bool(_HEX.fullmatch(v)) and len(v) in (32, 40, 64, 96, 128))


_PASSWORD = set("password passwd passphrase pass pwd pw".split())


def chosen(v: str) -> bool:
    """The look of a password somebody made up: eight characters or more of three kinds, or with digits and a mark."""
    kinds = (any(c.islower() for c in v), any(c.isupper() for c in v), any(c.isdigit() for c in v), any(not c.isalnum() for c in v))
    return len(v) >= 8 and kinds[2] and sum(kinds) >= 3 and not re.search(r"[/(){}\[\]<>]", v)


_PART = re.compile(r"[^\W_]+")
#: A value without quotes that is a dotted name, as of a function that reads settings.
_CODE = re.compile(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+")
_FUNCTION_WORDS = set("the a an is are was be been has have must can cannot to your you in on at of it this that for with and not or from by no if please enter invalid missing".split())


def prose(v: str, words: set[str]) -> bool:
    """Words with spaces between them, as in a message; under a password's name only with a word or an end that tells of a sentence."""
    if " " not in v:
        return False
    parts = _PART.findall(v)
    if not all(w.isalpha() and (w[1:].islower() or w.isupper() or len(w) == 1 or w.istitle()) or (w.isdigit() and len(w) <= 4) for w in parts):
        return False
    return not words & _PASSWORD or v.rstrip()[-1:] in ".:?," or not _FUNCTION_WORDS.isdisjoint(w.lower() for w in parts)


def weak_label(c: Candidate) -> int | None:
    """1, 0 or None where the patterns do not tell."""
    v, words = c.value, set(name_words(c.name))
    if placeholder(v) or c.kind == "literal" and prose(v, words):
        return 0
    if c.kind == "pem":
        return 1 if len(v) >= 40 else None
    if c.kind == "bare" and _CODE.fullmatch(v):
        return 0
    if c.kind in ("url", "conn"):
        return 1
    if c.kind == "known":
        return 1 if entropy(v) > 3 else None
    if c.kind == "header":
        return 1 if _random(v) or (len(v) >= 16 and entropy(v) > 3.2) else 0
    if words & DIGEST_WORDS and not words & STRONG_WORDS or words & BENIGN_WORDS:
        return 0
    if v.startswith(("sha1-", "sha256-", "sha384-", "sha512-", "data:", "ssh-", "urn:")) or _UUID.fullmatch(v) or v.isdigit():
        return 0
    if words & SECRET_WORDS and (_random(v) or (len(v) >= 16 and _HEX.fullmatch(v))):
        return 1
    if words & _PASSWORD and chosen(v):
        return 1
    if not words & SECRET_WORDS or len(v) < 6:
        return 0
    return None


FEATURES = 27


def _trial(path: str) -> bool:
    p = path.lower()
    return "test" in p or "spec" in p or "example" in p


def features(c: Candidate, plain: Markov, noise: Markov, path: str) -> list[float]:
    v, words = c.value, set(name_words(c.name))
    low = plain.score(v)
    high = noise.score(v)
    secret, strong, benign, digest = (bool(words & w) for w in (SECRET_WORDS, STRONG_WORDS, BENIGN_WORDS, DIGEST_WORDS))
    has = (any(x.islower() for x in v), any(x.isupper() for x in v), any(x.isdigit() for x in v), any(not x.isalnum() for x in v))
    return [
        1.0, high - low, min(len(v), 80) / 40, entropy(v) / 4, float(placeholder(v)), float(digestlike(v)), float(v.isdigit()),
        float(secret), float(strong), float(benign), float(digest), float(not words),
        float(c.kind == "url"), float(c.kind == "conn"), float(c.kind == "header"), float(c.kind == "pem"), float(c.kind == "bare"),
        float(bool(_KNOWN.fullmatch(v))), float(_random(v)), sum(has) / 4, float(strong and sum(has) >= 3 and not placeholder(v)),
        float(bool(_HEX.fullmatch(v)) and len(v) >= 16), float(secret and not benign and (strong or not digest) and _random(v)), float(c.kind == "known"), float(bool(words & _PASSWORD) and not benign and chosen(v)), float(_trial(path)),
        float(prose(v, words)),
    ]


@dataclass
class Model:
    plain: Markov
    noise: Markov
    weights: np.ndarray
    steps: list[tuple[float, float]]
    known: dict[tuple, float] = field(default_factory=dict)

    def score(self, c: Candidate, path: str) -> float:
        """Probability that the candidate is a credential; literals that come again are scored once."""
        key = (c.kind, c.name, c.value, _trial(path))
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 1 << 17:
                self.known.clear()
            got = self.known[key] = self._score(c, path)
        return got

    def _score(self, c: Candidate, path: str) -> float:
        z = float(np.dot(self.weights, features(c, self.plain, self.noise, path)))
        raw = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        out = self.steps[0][1]
        for at, p in self.steps:
            if raw < at:
                break
            out = p
        return out


class WordPairs:
    """Counts of the pairs of neighbouring characters in ordinary words, and in the last place of the words."""

    word = re.compile(r"[A-Za-z_][\w./-]{3,30}")

    def __init__(self):
        self.counts = np.zeros(96 * 96 + 1)
        self.random: dict[str, bool] = {}

    def _is_random(self, w: str) -> bool:
        got = self.random.get(w)
        if got is None:
            if len(self.random) > 1 << 17:
                self.random.clear()
            got = self.random[w] = _random(w)
        return got

    def add(self, texts: Iterable[str]):
        words: Counter = Counter()
        for t in texts:
            words.update(self.word.findall(t))
        kept = [(w, n) for w, n in words.items() if not self._is_random(w)]
        if kept:
            codes = np.frombuffer((" " + " ".join(w for w, _ in kept) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            codes = np.clip(codes - 32, 0, 95)
            times = np.repeat([float(n) for _, n in kept], [len(w) + 1 for w, _ in kept])
            self.counts[:-1] += np.bincount(codes[:-1] * 96 + codes[1:], times, 96 * 96)
        self.counts[-1] += sum(words.values())
        return self


def _fold(c: Candidate) -> int:
    """Equal values are in one fold."""
    return zlib.crc32(f"{c.kind}\0{c.name}\0{c.value}".encode("utf-8", "surrogatepass")) % FOLDS


def _noise(rng: np.random.Generator) -> Markov:
    return Markov().learn("".join(rng.choice(list(_ALNUM), 24)) for _ in range(2000)).learn("".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(600)).done()


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _drawn(rng: np.random.Generator) -> list[tuple[Candidate, int]]:
    """Values and labels that tables may not hold: random values that nothing names are data; those in a place for
    credentials, or under their names, are such, and placeholders and digests are not."""
    base64 = list(_ALNUM + "+/")
    drawn = [Candidate([], "".join(rng.choice(base64, int(n))), "", "literal") for n in rng.integers(12, 100, 300)]
    places = [("header", ""), ("url", ""), ("conn", ""), ("pem", ""), ("known", ""), ("literal", "password"), ("bare", "secret_token")]
    for kind, name in places:
        drawn += [Candidate([], "".join(rng.choice(list(_ALNUM), int(n))), name, kind) for n in rng.integers(12, 60, 40) if kind != "pem" or n >= 40]
        drawn += [Candidate([], c * int(n), name, kind) for c, n in zip("x*0.X#-x", rng.integers(6, 30, 8))]
        drawn += [Candidate([], v, name, kind) for v in ("${TOKEN}", "<token>", "changeme", "%(key)s", "{{ key }}", "ghp_" + "0" * 36, "AKIA" + "X" * 16, "example")]
    for word in sorted(DIGEST_WORDS):
        drawn += [Candidate([], "".join(rng.choice(list("0123456789abcdef"), n)), word, "literal") for n in (32, 40, 64)]
    drawn += [Candidate([], str(n), f"{secret}_{word}", "literal") for word in sorted(BENIGN_WORDS) for secret in ("password", "token") for n in rng.integers(1, 9999, 2)]
    lower = list("abcdefghijklmnopqrstuvwxyz")
    drawn += [Candidate([], "".join(rng.choice(lower, int(n))).capitalize() + f"{rng.integers(10, 9999)}{mark}", name, kind) for kind, name in (("literal", "password"), ("literal", "db_pw"), ("bare", "passphrase")) for n in rng.integers(4, 9, 12) for mark in "!#&"]
    words = [*sorted(_FUNCTION_WORDS), "30", "2", "2024"]
    drawn += [Candidate([], " ".join(rng.choice(words, int(n))).capitalize() + end, name, "literal") for name in ("token_message", "secret", "password_error", "") for n in rng.integers(3, 12, 12) for end in (".", "!")]
    return [(c, y) for k, c in enumerate(drawn) if (y := 0 if k < 300 else weak_label(c)) is not None]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, weights: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of ``FOLDS`` regressions, each without a fold, and of the one over all; ``share`` is what a
    value of either label weighs in each."""
    out = np.empty((FOLDS + 1, 1 + FEATURES + FEATURES**2))
    for j in range(FOLDS + 1):
        use = fold != j
        a, t = x[use], y[use]
        b, z = share[j][t], a @ weights[j]
        p = _sigmoid(z)
        out[j, 0] = b @ np.logaddexp(0, np.where(t == 1, -z, z))
        out[j, 1 : 1 + FEATURES] = (b * (p - t)) @ a
        out[j, 1 + FEATURES :] = ((a * (b * p * (1 - p))[:, None]).T @ a).ravel()
    return out


def _minimum(sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Newton's method with halved steps where the loss would rise, all regressions at once."""
    models = FOLDS + 1
    w, step, least = np.zeros((models, FEATURES)), np.zeros((models, FEATURES)), np.full(models, np.inf)
    done = np.zeros(models, bool)
    while not done.all():
        at = w - step
        got = sums(at)
        loss = got[:, 0] + RIDGE / 2 * (at**2).sum(axis=1)
        for j in np.flatnonzero(~done):
            if loss[j] <= least[j]:
                w[j], least[j] = at[j], loss[j]
                slope = got[j, 1 : 1 + FEATURES] + RIDGE * w[j]
                step[j] = np.linalg.solve(got[j, 1 + FEATURES :].reshape(FEATURES, FEATURES) + RIDGE * np.eye(FEATURES), slope)
                done[j] = step[j] @ slope < 1e-9
            else:
                step[j] /= 2
                done[j] = np.abs(step[j]).max() < 1e-9
            if done[j]:
                step[j] = 0
    return w


def _pooled(blocks: Iterable[tuple[float, float, float, float]]) -> list[list[float]]:
    """Pooled adjacent violators of sorted (lowest score, positives, all, highest score); blocks pooled before may be pooled on."""
    out: list[list[float]] = []
    for b in blocks:
        out.append(list(b))
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            _, t, n, hi = out.pop()
            out[-1][1] += t
            out[-1][2] += n
            out[-1][3] = hi
    return out


def _steps(blocks: list[list[float]]) -> list[tuple[float, float]]:
    """(lower bound of the raw score, calibrated probability)."""
    steps = []
    for k, (r, t, n, _) in enumerate(blocks):
        if k:  # halfway, in log odds, to the highest score of the block below
            z = [math.log(max(q, 1e-9) / max(1 - q, 1e-9)) for q in (blocks[k - 1][3], r)]
            r = 1 / (1 + math.exp(-(z[0] + z[1]) / 2))
        steps.append((r, (t + 0.01) / (n + 0.02)))
    return steps


def _ranked(x: np.ndarray, y: np.ndarray, fold: np.ndarray, weights: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Sorted blocks of equal scores, every value's from the regression without its fold."""
    at, where = np.unique(_sigmoid((x * weights[fold]).sum(axis=1)), return_inverse=True)
    return list(zip(at.tolist(), np.bincount(where, y).tolist(), np.bincount(where).tolist(), at.tolist()))


_FIXED = np.zeros(FEATURES)
_FIXED[[0, 1, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 15, 17, 18, 20, 22, 23, 24, 26]] = [-4, 0.5, -6, -1, -3, 1, 2, -4, -4, 5, 5, 2, 5, 2, 1, 0.5, 2, 4, 5, -8]


def _learn(plain: Markov, noise: Markov, rng: np.random.Generator, counts: np.ndarray, sums: Callable, blocks: Callable) -> Model:
    """``counts``: labelled values by fold and label; ``sums(weights, share)`` and ``blocks(weights)`` go over all of them. Drawn
    values teach the weights only: probabilities are those of the tables."""
    if counts.sum() < 50 or not counts.sum(axis=0).all():
        return Model(plain, noise, _FIXED, [(0.0, 0.01), (0.5, 0.9)])
    drawn = _drawn(rng)
    x, y = np.array([features(c, plain, noise, "") for c, _ in drawn]), np.array([t for _, t in drawn])
    fold = np.array([_fold(c) for c, _ in drawn])
    weight = max(1.0, DRAWN_SHARE * counts.sum() / len(drawn))
    each = counts + weight * np.array([[np.sum((fold == f) & (y == t)) for t in (0, 1)] for f in range(FOLDS)])
    share = 0.5 / np.array([*(each.sum(axis=0) - each), each.sum(axis=0)])
    w = _minimum(lambda at: sums(at, share) + _sums(x, y, fold, at, share * weight))
    return Model(plain, noise, w[FOLDS], _steps(blocks(w)))


def train(rows: list[tuple[str, str, str]], seed: int = 5) -> Model:
    """From (path, given name or '', text)."""
    rng = np.random.default_rng(seed)
    noise = _noise(rng)
    plain = Markov().add(WordPairs().add(t for _, _, t in rows if t).counts).done()
    got = [(c, path, y) for path, name, text in rows if text for c in candidates(text, name) if (y := weak_label(c)) is not None]
    x = np.array([features(c, plain, noise, p) for c, p, _ in got]).reshape(-1, FEATURES)
    y, fold = np.array([y for *_, y in got], int), np.array([_fold(c) for c, *_ in got], int)
    counts = np.bincount(fold * 2 + y, minlength=2 * FOLDS).reshape(FOLDS, 2).astype(float)
    return _learn(plain, noise, rng, counts, lambda w, share: _sums(x, y, fold, w, share), lambda w: _pooled(_ranked(x, y, fold, w)))


def _texts(chunks: DataFrame, env: DataFrame) -> DataFrame:
    a = chunks.select(F.lit("chunks").alias("table_name"), "id", F.lit("").alias("name"), F.col("file_path").alias("path"), F.col("content").alias("text"))
    b = env.select(F.lit("env_vars").alias("table_name"), "id", F.coalesce("name", F.lit("value")).alias("name"), F.col("file_path").alias("path"), F.col("default_value").alias("text"))
    return a.unionByName(b).filter("length(text) > 0")


def _columns(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def _kept(df: DataFrame, name: str) -> DataFrame:
    at = f"{ensure_checkpoint_dir(df.sparkSession)}/credentials-{uuid.uuid4().hex}-{name}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def learned(chunks: DataFrame, env: DataFrame, seed: int = 5) -> tuple[Model, DataFrame]:
    """A model from all rows of both tables, and (table_name, id, fold, label, x) of all their candidates."""
    spark = chunks.sparkSession
    rng = np.random.default_rng(seed)
    noise = _noise(rng)
    pieces = pa.schema([("table_name", pa.string()), ("id", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("value", pa.string()), ("trial", pa.bool_()), ("times", pa.float64())])

    def read(batches):
        pairs = WordPairs()
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(5))))
            pairs.add(t for *_, t in rows)
            yield _columns(pieces, [(t, i, c.kind, c.name, c.value, _trial(path or ""), None) for t, i, name, path, text in rows for c in candidates(text, name)])
        yield _columns(pieces, [(None, int(k), None, None, None, None, float(pairs.counts[k])) for k in np.flatnonzero(pairs.counts)])

    found = _kept(_texts(chunks, env).mapInArrow(read, "table_name string, id bigint, kind string, name string, value string, trial boolean, times double"), "candidates")
    pairs = np.zeros(96 * 96 + 1)
    for r in found.filter("kind is null").groupBy("id").agg(F.sum("times").alias("times")).collect():
        pairs[r.id] = r.times
    plain = Markov().add(pairs).done()
    chains = spark.sparkContext.broadcast((plain, noise))
    described = pa.schema([("table_name", pa.string()), ("id", pa.int64()), ("fold", pa.int32()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def describe(batches):
        known: dict[tuple, tuple] = {}
        for batch in batches:
            rows = []
            for t, i, kind, name, value, trial in zip(*(batch.column(k).to_pylist() for k in range(6))):
                key = (kind, name, value, trial)
                got = known.get(key)
                if got is None:
                    if len(known) > 1 << 15:
                        known.clear()
                    c = Candidate([], value, name, kind)
                    got = known[key] = (_fold(c), weak_label(c), features(c, *chains.value, "test" if trial else ""))
                rows.append((t, i, *got))
            yield _columns(described, rows)

    given = _kept(found.filter("kind is not null").drop("times").mapInArrow(describe, "table_name string, id bigint, fold int, label int, x array<double>"), "features")
    labelled = given.filter("label is not null").select("fold", "label", "x")
    counts = np.zeros((FOLDS, 2))
    for r in labelled.groupBy("fold", "label").count().collect():
        counts[r.fold, r.label] = r["count"]

    def sums(w, share):
        def part(batches):
            out = np.zeros((FOLDS + 1, 1 + FEATURES + FEATURES**2))
            for b in batches:
                out += _sums(_matrix(b, "x"), b.column("label").to_numpy(), b.column("fold").to_numpy(), w, share)
            yield pa.RecordBatch.from_pydict({"sums": pa.array([out.tobytes()], pa.binary())})

        return sum(np.frombuffer(r.sums).reshape(FOLDS + 1, -1) for r in labelled.mapInArrow(part, "sums binary").collect())

    kind = pa.schema([(k, pa.float64()) for k in ("lo", "t", "n", "hi")])

    def blocks(w):
        def rank(batches):
            for b in batches:
                yield _columns(kind, _ranked(_matrix(b, "x"), b.column("label").to_numpy(), b.column("fold").to_numpy(), w))

        def pool(batches):
            yield _columns(kind, _pooled(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))))

        schema = "lo double, t double, n double, hi double"
        d = labelled.mapInArrow(rank, schema).groupBy("lo").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).withColumn("hi", F.col("lo"))
        return _pooled(sorted(tuple(r) for r in d.orderBy("lo").mapInArrow(pool, schema).collect()))

    return _learn(plain, noise, rng, counts, sums, blocks), given


def fit(chunks: DataFrame, env: DataFrame) -> Model:
    """From all rows of both tables."""
    return learned(chunks, env)[0]


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    for a, b in sorted(spans, reverse=True):
        text = text[:a] + REDACTED + text[b:]
    return text


_SCHEMA = "table_name string, id bigint, n int, score double, redacted string"


def scan(chunks: DataFrame, env: DataFrame, model: Model | None = None, threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """(table_name, id, n credentials, best score, redacted text) of every row that holds at least one."""
    model = model or fit(chunks, env)
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            out = []
            for t, i, name, path, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if not text:
                    continue
                hits = [(s, c) for c in candidates(text, name) if (s := m.score(c, path or "")) >= threshold]
                if hits:
                    red = redact(text, [x for _, c in hits for x in c.spans]) if keep_text else None
                    out.append((t, i, len(hits), max(s for s, _ in hits), red))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["table_name", "id", "n", "score", "redacted"])

    return _texts(chunks, env).filter("id is not null").mapInArrow(run, _SCHEMA)


def found(chunks: DataFrame, env: DataFrame, model: Model | None = None) -> DataFrame:
    if model:
        return scan(chunks, env, model, keep_text=False).select("table_name", "id").distinct()
    model, given = learned(chunks, env)
    weights, (at, p) = model.weights, map(np.array, zip(*model.steps))

    def run(batches):
        for b in batches:
            k = np.searchsorted(at, _sigmoid(_matrix(b, "x") @ weights), side="right") - 1
            yield b.filter(pa.array(p[np.maximum(k, 0)] >= THRESHOLD)).select(["table_name", "id"])

    return given.filter("id is not null").select("table_name", "id", "x").mapInArrow(run, "table_name string, id bigint").distinct()
