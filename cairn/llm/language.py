"""Languages of documents and of the segments of mixed ones: a linear-chain conditional random field over words.

Every word of a text gets one of the model's languages or no prose as its label. The languages are those of the lexicon and
every other one that the corpus' labels name often enough and its sentences bear out. A word's features are its affixes, its
character n-grams, lexicon scores (how often each language's training text uses it) and the kind of line it stands in (prose,
code or log by its look; what that tells is learned); transitions between labels are learned. Forward-backward gives each
word's label probabilities, so that a passage of a few sentences inside another language comes out as a segment of its own,
with the mean probability as confidence.

Training takes a bounded sample (``train_docs`` labelled documents in hash order, of at most ``train_chars`` characters
each, and ``sentences`` of their sentences for the field) on the driver. Long texts are read in windows of ``CHAIN`` words
that reach ``SEAM`` words into their neighbours. Labels of documents are noisy and documents mixed, so the labels are only a
start: lexicon counts from them label sentences, and the sentences' labels, twice re-estimated, train the field. Everything
else covers all rows and whole texts.

Fenced blocks, inline code, paths, references and identifiers are no words. A language counts as present with a run of at
least ``MIN_RUN`` of its words of a mean probability of ``MIN_CONFIDENCE``.

Defined cases: null, empty and blank texts and texts without prose have no segments; a corpus without labelled documents
is trained on the built-in function words alone; repeated rows are repeated in the segments and once in ``languages``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm.common import spread, thinned

#: Language codes and some function words of each.
FUNCTION_WORDS = {
    "en": "the of and to is are not with when before after every this our which",
    "de": "der die das und nicht ist mit wenn ein eine nach jede dieser unser noch",
    "fr": "le la les des est avec quand une dans chaque cette notre ne pas plus",
    "es": "el los las es con cuando una en cada este nuestro del no por y",
    "pt": "o os as é com quando uma em cada este nosso do não por e",
    "it": "il gli è con quando una nel ogni questo nostro della non per dopo e",
    "nl": "de het een en is met wanneer elke deze onze niet nog na geen zijn",
    "ru": "и в не на с когда после каждый этот наш все до что это как",
}
LANGUAGES = list(FUNCTION_WORDS)
MIN_RUN = 4
MIN_CONFIDENCE = 0.9
BUCKETS = 1 << 14
CHAIN, SEAM = 192, 32

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_INLINE = re.compile(r"`[^`\n]*`")
_FENCE = re.compile(r"\s*(```|~~~)")
_MARKUP = re.compile(r"`[^`\n]*`|<[^<>\n]*>")
_NO_WORD = re.compile(r"[_/\\@#$=]|\w\.\w|\d|[a-z][A-Z]")
_CODE = re.compile(
    r"\s*(?://|/\*|\*[\s/]|\*$|--\s|\"\"\"|'''|#\S|@\w|\$\s|>>>\s|[{}\[\]()<]|\s{4}#|[\w.]+\(.*\)[;:]?$|(?:import|package|using|namespace)\s[\w.]+;?$|import\s.*[\"';{]|from\s\S+\simport\s|export\s|const\s|let\s|var\s|func\s|def\s|class\s\w+\W|return\b.{0,60}$|(?:public|private|static)\s|(?:for|if|elif|while|with|except|try|else|class|def|async)\b.*:\s*$|(?:foreach|for|if|while|switch|catch|lock)\s*\(|raise\s+\w+\(|throw\s|(?:SELECT|INSERT|CREATE|UPDATE)\s)"
    r"|.*(?:[;{}(\[=]|=>|\):)\s*$|.*(?:\s:?=\s|==|!=|=>|->|\w\(\)|\w\[|;\s*$)|\s*\w+:\s*\S*$"
)
_LOG = re.compile(r"\s*(?:\[?\d{4}-\d\d-\d\d|\[?\d\d:\d\d|Traceback \(|File \"|at \S+\(|\w*(?:Error|Exception)\b:|(?:\[?(?:INFO|WARN|WARNING|ERROR|DEBUG|FATAL|TRACE)\]?)\b)")

Line = tuple[int, list[str]]  # kind of line (0 plain, 1 code, 2 log), words


def _words(line: str) -> list[str]:
    """Words of a line without inline code, tags, paths, references and identifiers."""
    return [w for t in _MARKUP.sub(" ", line).split() if not _NO_WORD.search(t) for w in _WORD.findall(t)]


def _kind(line: str) -> int:
    return 2 if _LOG.match(line) else 1 if _CODE.match(_INLINE.sub("`", line)) else 0


def read_lines(text: str | None) -> list[Line]:
    """Words of a text by line, without fenced blocks and what is no word."""
    out: list[Line] = []
    fence = False
    for line in (text or "").splitlines():
        if _FENCE.match(line):
            fence = not fence
            continue
        if fence or not line.strip():
            continue
        kind = _kind(line)
        ws = _words(line)
        if ws:
            out.append((kind, ws))
    return out


def _sentences(text: str | None):
    """Training view: (kind, words) of every sentence."""
    fence = False
    for line in (text or "").splitlines():
        if _FENCE.match(line):
            fence = not fence
            continue
        if fence or not line.strip():
            continue
        kind = _kind(line)
        for s in _SENTENCE.split(line):
            ws = _words(s)
            if ws:
                yield kind, ws


def _hashed(word: str) -> list[int]:
    """Buckets of the affixes and n-grams of a word."""
    w = f"^{word}$"
    grams = {f"p{w[:k]}" for k in (2, 3, 4)} | {f"s{w[-k:]}" for k in (2, 3, 4)} | {w[i : i + 3] for i in range(len(w) - 2)}
    return [zlib.crc32(g.encode()) % BUCKETS for g in sorted(grams)]


class Model:
    """Weights of the field; small (some 0.6 MB), sent to the workers as it is. Its last label is no prose."""

    def __init__(self, languages: list[str], counts: np.ndarray, vocabulary: dict[str, int], hashed: np.ndarray, lexicon: np.ndarray, kinds: np.ndarray, start: np.ndarray, moves: np.ndarray):
        self.languages = languages
        self.counts, self.vocabulary, self.hashed, self.lexicon, self.kinds, self.start, self.moves = counts, vocabulary, hashed, lexicon, kinds, start, moves

    def scores(self, word: str) -> np.ndarray:
        w = word.lower()
        h = _hashed(w)
        s = self.hashed[h].sum(axis=0) / np.sqrt(len(h))
        at = self.vocabulary.get(w)
        return s + (self.counts[at] if at is not None else self.counts[-1]) * self.lexicon


def _log_odds(counts: np.ndarray) -> np.ndarray:
    """Lexicon scores of every word: log share per language, centred; x scores 0."""
    share = np.log((counts + 0.05) / (counts.sum(axis=0) + 50))
    out = np.zeros((len(counts), counts.shape[1] + 1))
    out[:, :-1] = share - share.mean(axis=1, keepdims=True)
    return np.clip(out, -8, 8)


def train(rows: list[tuple[str, str]], epochs: int = 60, seed: int = 3, sentences: int = 6000, least: int = 20) -> Model:
    """From (language code or anything else, text) rows, of whose sentences ``sentences`` are drawn for the field.

    Languages are those of the lexicon and every other code that ``least`` documents carry, unless its words are those of a
    language with more documents: such a code is a wrong label."""
    seen = Counter(lang for lang, _ in rows if re.fullmatch(r"[a-z]{2,3}", lang or ""))
    languages = [*LANGUAGES, *sorted(c for c, n in seen.items() if n >= least and c not in LANGUAGES)]
    model, wrong = _train(rows, languages, epochs, seed, sentences)
    return model if not wrong else _train(rows, [c for c in languages if c not in wrong], epochs, seed, sentences)[0]


def _train(rows: list[tuple[str, str]], languages: list[str], epochs: int, seed: int, sentences: int) -> tuple[Model | None, set[str]]:
    X, N = len(languages), len(languages) + 1  # noqa: N806
    vocabulary: dict[str, int] = {}
    docs = [(languages.index(lang) if lang in languages else -1, [(kind, [w.lower() for w in ws]) for kind, ws in _sentences(text)]) for lang, text in rows]
    prior = [(languages.index(c), w) for c, ws in FUNCTION_WORDS.items() for w in ws.split()]
    for _, sents in docs:
        for kind, ws in sents:
            for w in ws:
                vocabulary.setdefault(w, len(vocabulary))
    for _, w in prior:
        vocabulary.setdefault(w, len(vocabulary))
    v = len(vocabulary)
    base = np.zeros((v + 1, X))
    for i, w in prior:
        base[vocabulary[w], i] += 3
    counts = base.copy()
    for lang, sents in docs:
        if lang >= 0:
            for kind, ws in sents:
                if kind == 0:
                    for w in set(ws):
                        counts[vocabulary[w], lang] += 1
    labels: list[tuple[int, list[int], int]] = []
    share = counts - base
    share = share / np.maximum(np.linalg.norm(share, axis=0), 1e-9)
    alike = share.T @ share
    size = np.bincount([d for d, _ in docs if d >= 0], minlength=X)
    wrong = {c for i, c in enumerate(languages) if c not in LANGUAGES and any(alike[i, j] > 0.8 and (size[j], -j) > (size[i], -i) for j in range(X) if j != i)}
    if wrong:
        return None, wrong
    for _ in range(3):  # label sentences, count again
        odds, new, labels = _log_odds(counts)[:, :X], base.copy(), []
        for _, sents in docs:
            for kind, ws in sents:
                ids = [vocabulary[w] for w in ws]
                if kind:
                    labels.append((X, ids, kind))
                    continue
                total = odds[ids].sum(axis=0)
                best = int(total.argmax())
                margin = total[best] - np.partition(total, -2)[-2]
                if len(ids) >= 3 and margin > 2:
                    labels.append((best, ids, 0))
                    np.add.at(new, (ids, best), 1)
        counts = new
    if not labels:
        labels = [(i, [vocabulary[w] for w in ws.split()], 0) for i, ws in enumerate(FUNCTION_WORDS.values())]
    odds = _log_odds(counts)

    # words that carry no evidence are learned as unknown ones: a tenth of the tokens lose their lexicon entry
    rng = np.random.default_rng(seed)
    names = [None] * v
    for w, i in vocabulary.items():
        names[i] = w
    flat_h = [_hashed(w) for w in names]
    h_rows = np.repeat(np.arange(v), [len(h) for h in flat_h])
    h_cols = np.fromiter((x for h in flat_h for x in h), np.int64)
    h_val = 1 / np.sqrt(np.array([len(h) for h in flat_h]))[h_rows]

    # chains: some sentences one after the other, as they may follow in a mixed text
    order = rng.permutation(len(labels))[:sentences]
    for kind in (1, 2):  # where the sample shows few lines of code or logs: any words in such a line are no prose
        if sum(labels[i][2] == kind for i in order) < 40:
            order = np.append(order, np.arange(len(labels), len(labels) + 80))
            labels = labels + [(X, rng.choice(v, 6).tolist(), kind) for _ in range(80)]
    order = rng.permutation(order)
    chains, at = [], 0
    while at < len(order):
        k = int(rng.integers(1, 4))
        chain: list[tuple[int, int, int]] = []
        for s in order[at : at + k]:
            lab, ids, kind = labels[s]
            chain += [(i, kind, lab) for i in ids]
        chains.append(chain[:CHAIN])
        at += k
    chains.sort(key=len)
    batches = [_pad(chains[i : i + 256]) for i in range(0, len(chains), 256)]

    theta = {"hashed": np.zeros((BUCKETS, N)), "lexicon": np.ones(N) * 0.5, "kinds": np.zeros((3, N)), "start": np.zeros(N), "moves": np.eye(N) * 2.0}
    m = {k: np.zeros_like(x) for k, x in theta.items()}
    s = {k: np.zeros_like(x) for k, x in theta.items()}
    for epoch in range(1, epochs + 1):
        hv = np.zeros((v, N))
        np.add.at(hv, h_rows, theta["hashed"][h_cols] * h_val[:, None])
        g_word, g_unknown = np.zeros((v, N)), np.zeros(N)
        g = {k: np.zeros_like(x) for k, x in theta.items()}
        tokens = 0
        for words, kinds, labs, mask in batches:
            known = rng.random(words.shape) > 0.1
            lex = np.where(known[..., None], odds[words], odds[-1])
            em = hv[words] + lex * theta["lexicon"] + theta["kinds"][kinds]
            post, pair = forward_backward(em, mask, theta["start"], theta["moves"], pairs=True)
            gold = np.eye(N)[labs] * mask[..., None]
            d = post * mask[..., None] - gold
            np.add.at(g_word, words.ravel(), d.reshape(-1, N))
            g["lexicon"] += (d * lex).sum(axis=(0, 1))
            np.add.at(g["kinds"], kinds.ravel(), d.reshape(-1, N))
            g["start"] += d[:, 0].sum(axis=0)
            both = mask[:, 1:] * mask[:, :-1]
            np.add.at(pair, (labs[:, :-1].ravel(), labs[:, 1:].ravel()), -both.ravel())
            g["moves"] += pair
            tokens += mask.sum()
        np.add.at(g["hashed"], h_cols, g_word[h_rows] * h_val[:, None])
        for k in theta:  # Adam with a small ridge
            grad = g[k] / tokens * 50 + 1e-4 * theta[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.99 * s[k] + 0.01 * grad**2
            theta[k] = theta[k] - 0.1 * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(s[k] / (1 - 0.99**epoch)) + 1e-8)
    keep = {w: i for w, i in vocabulary.items() if counts[i].any()}
    table = np.concatenate([odds[list(keep.values())], odds[-1:]]).astype(np.float32)
    return Model(languages, table, {w: k for k, w in enumerate(keep)}, theta["hashed"].astype(np.float32), theta["lexicon"], theta["kinds"], theta["start"], theta["moves"]), set()


def _pad(chains):
    t = max(map(len, chains))
    words, kinds, labs = (np.zeros((len(chains), t), np.int64) for _ in range(3))
    mask = np.zeros((len(chains), t))
    for i, c in enumerate(chains):
        a = np.array(c)
        words[i, : len(c)], kinds[i, : len(c)], labs[i, : len(c)], mask[i, : len(c)] = a[:, 0], a[:, 1], a[:, 2], 1
    return words, kinds, labs, mask


def forward_backward(em: np.ndarray, mask: np.ndarray, start: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Label probabilities (B, T, N) of padded chains, and the summed pair expectations; scaled, so long chains are safe."""
    b, t, n = em.shape
    e = np.exp(em - em.max(axis=2, keepdims=True))
    a = np.exp(moves - moves.max())
    alpha, beta = np.empty((b, t, n)), np.ones((b, t, n))
    alpha[:, 0] = np.exp(start - start.max()) * e[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        x = (alpha[:, i - 1] @ a) * e[:, i]
        alpha[:, i] = x / x.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        x = (beta[:, i + 1] * e[:, i + 1]) @ a.T
        beta[:, i] = np.where(mask[:, i + 1, None] > 0, x / x.sum(axis=1, keepdims=True), 1.0)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    if not pairs:
        return post
    pair = np.zeros((n, n))
    for i in range(t - 1):
        on = mask[:, i + 1] > 0
        if not on.any():
            break
        p = alpha[on, i][:, :, None] * a[None] * (e[on, i + 1] * beta[on, i + 1])[:, None, :]
        pair += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return post, pair


class Labeller:
    """Segments of texts; scores of words are kept in a table that is emptied when it holds ``memo`` words."""

    def __init__(self, model: Model, memo: int = 200_000):
        self.model, self.limit = model, memo
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.start)))

    def _row(self, w: str) -> int:
        k = self.at.get(w)
        if k is None:
            k = len(self.at)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[k] = self.model.scores(w)
            self.at[w] = k
        return k

    def segments(self, texts: list[str | None]) -> list[list[tuple[str, int, float]]]:
        """For each text its runs (language, words, confidence) in order; runs of no prose are left out."""
        if len(self.at) > self.limit:
            self.at.clear()
        chains: list[tuple[int, list[int], list[int]]] = []
        keep: list[tuple[int, int]] = []
        for d, text in enumerate(texts):
            ids: list[int] = []
            kinds: list[int] = []
            for kind, ws in read_lines(text):
                ids += [self._row(w) for w in ws]
                kinds += [kind] * len(ws)
            for i in range(0, len(ids), CHAIN):  # one document's chains follow each other; each reads beyond its seams
                a, z = max(0, i - SEAM), i + CHAIN + SEAM
                chains.append((d, ids[a:z], kinds[a:z]))
                keep.append((i - a, min(CHAIN, len(ids) - i)))
        post: list[np.ndarray | None] = [None] * len(chains)
        order = sorted(range(len(chains)), key=lambda k: len(chains[k][1]))
        m = self.model
        for i in range(0, len(order), 512):
            some = order[i : i + 512]
            words, kinds, _, mask = _pad([list(zip(chains[k][1], chains[k][2], chains[k][2])) for k in some])
            p = forward_backward(self.table[words] + m.kinds[kinds], mask, m.start, m.moves)
            for row, k in enumerate(some):
                a, n = keep[k]
                post[k] = p[row, a : a + n]
        by_doc: list[list[np.ndarray]] = [[] for _ in texts]
        for (d, _, _), p in zip(chains, post):
            by_doc[d].append(p)
        return [_runs(np.concatenate(ps), m.languages) if ps else [] for ps in by_doc]


def _runs(post: np.ndarray, languages: list[str]) -> list[tuple[str, int, float]]:
    best = post.argmax(axis=1)
    top = post.max(axis=1)
    edges = np.flatnonzero(np.diff(best)) + 1
    out: list[tuple[str, int, float]] = []
    for a, b in zip([0, *edges], [*edges, len(best)]):
        if best[a] != len(languages) and b - a >= MIN_RUN:
            lang, n, conf = languages[best[a]], int(b - a), float(top[a:b].mean())
            if conf < MIN_CONFIDENCE:
                continue
            if out and out[-1][0] == lang:
                _, n0, c0 = out.pop()
                n, conf = n + n0, (conf * n + c0 * n0) / (n + n0)
            out.append((lang, n, conf))
    return out


def fit(documents: DataFrame, train_docs: int = 4000, train_chars: int = 20_000) -> Model:
    """Train on a bounded sample of labelled documents in hash order."""
    d = thinned(documents.select("doc_id", "text", "lang"), "doc_id", train_docs).filter((F.trim("lang") != "") & (F.length("text") <= train_chars))
    rows = d.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).select(F.lower("lang"), "text").toArrow()
    return train(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())))


def language_segments(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang, segment, language, words, confidence): the prose segments of every document, in order."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents))

    def run(batches):
        lab = Labeller(shared.value)
        for b in batches:
            ids, langs = b.column(0).to_pylist(), b.column(2).to_pylist()
            rows = [(ids[d], langs[d], k, *s) for d, segs in enumerate(lab.segments(b.column(1).to_pylist())) for k, s in enumerate(segs)]
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "lang", "segment", "language", "words", "confidence"])

    return spread(documents.select("doc_id", "text", "lang")).mapInArrow(run, "doc_id bigint, lang string, segment int, language string, words int, confidence double")


def languages(segments: DataFrame) -> DataFrame:
    """(doc_id, lang, languages array): each document's given label and the languages found, most words first."""
    per = segments.groupBy("doc_id", "lang", "language").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("w"), "language", "confidence")))
    return per.groupBy("doc_id", "lang").agg(best.alias("found")).select("doc_id", "lang", F.transform("found", lambda x: F.struct(x["language"].alias("language"), (-x["w"]).alias("words"), x["confidence"].alias("confidence"))).alias("languages"))


def label_errors(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang): the right language of documents with a missing or wrong label, all languages of mixed ones."""
    d = languages(language_segments(documents, model))
    one = F.size("languages") == 1
    right = F.lower(F.trim(F.coalesce("lang", F.lit("")))) == F.col("languages")[0]["language"]
    return d.filter(~(one & right)).select("doc_id", F.explode("languages.language").alias("lang")).distinct()
