"""Secret scan with character Markov models (operator 11).

Three fixed patterns give the base findings. Beside them, every run of token
characters of a text is rated by two kinds of character Markov chains: one chain
per alphabet of random strings, and one chain of ordinary identifiers. The
log-likelihood ratio of the two decides; the chains and the cut are learned from
labelled samples (``labelled_samples`` takes them from a corpus).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm.common import Shared, map_texts
from candor.session import written

# fixed values: the base findings, in the order in which equal starts are listed
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
MARKOV = "markov"

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"  # characters of a token
START = len(SYMBOLS)  # stands before a token
LEAST_TOKEN = 16  # characters of a token that is rated
SAMPLE_DOCUMENTS = 4_000  # documents that labelled samples are taken from
SAMPLE_TOKENS = 60_000  # distinct labelled tokens of each label
TOKEN_CHARS = 256  # a sampled token is learned from up to so many characters; rated tokens are read whole
GENERATED = 400  # random strings drawn per alphabet, so that the chains know alphabets that a corpus lacks
FALSE_SHARE = 1e-4  # share of ordinary held-back tokens that may pass the cut
LEAST_RATIO = 12.0  # the cut is never below this log-likelihood ratio
LEAST_PER_SYMBOL = 2.0  # and a finding's ratio exceeds this for each of its characters
MIX = (0.5, 0.3, 0.2)  # shares of the contexts of two symbols, one symbol and one symbol's class
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "url_base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
ORDINARY = "ordinary"

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
# the maximal runs that are long enough; no shorter run has to be built
_HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{LEAST_HEX},}}")
_CLASS = r"[A-Za-z0-9+/_=\-]"
_TOKEN = re.compile(rf"(?<!{_CLASS}){_CLASS}{{{LEAST_TOKEN},}}")
#: class of each symbol: upper, lower, digit, other; START is a class of its own
CLASS = np.array([0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in SYMBOLS] + [4])
_CODE = np.full(128, START, np.int64)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base findings by start, then kind; code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def tokens_between(text: str, spans: list[tuple[int, int, int]], least: int = LEAST_TOKEN) -> list[tuple[int, int]]:
    """Maximal runs of token characters that touch none of ``spans``."""
    pattern = _TOKEN if least == LEAST_TOKEN else re.compile(rf"(?<!{_CLASS}){_CLASS}{{{least},}}")
    runs = [m.span() for m in pattern.finditer(text)]
    if not spans or not runs:
        return runs
    taken = sorted((s, e) for s, _, e in spans)
    starts = np.array([s for s, _ in taken])
    ends = np.maximum.accumulate([e for _, e in taken])
    out = []
    for s, e in runs:
        before = int(np.searchsorted(starts, e))  # spans that start before the run's end
        if before == 0 or ends[before - 1] <= s:
            out.append((s, e))
    return out


def coded(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol numbers of all tokens in one array, with the start of each token."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    raw = np.frombuffer("".join(tokens).encode("ascii"), np.uint8)
    return _CODE[raw], np.cumsum(sizes) - sizes


def contexts(codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before each symbol; START stands before a token."""
    one = np.concatenate([[START], codes[:-1]])
    two = np.concatenate([[START, START], codes[:-2]])[: len(codes)]
    one[begin] = START
    two[begin] = START
    second = begin + 1
    second = second[second < len(codes)]
    two[second] = START
    return one, two


def chain(tokens: list[str], order: int) -> np.ndarray:
    """log P(symbol | symbols before) from samples, mixed by fixed shares (MIX).

    The mixed parts are the context of two symbols (``order`` 2 only), of one symbol, and of the class of one symbol (upper,
    lower, digit, other) with even chances inside the class that follows, so that what no sample shows is judged by its classes.
    Order 2 has shape (68, 68, 67), where START is a context only; order 1 has (68, 67).
    """
    k, n = START + 1, len(SYMBOLS)
    counts = np.zeros(k * k * n)
    if tokens:
        codes, begin = coded(tokens)
        one, two = contexts(codes, begin)
        np.add.at(counts, (two * k + one) * n + codes, 1.0)
    counts = counts.reshape(k, k, n)
    pairs = counts.sum(0)
    into = np.eye(5)[CLASS[:n]][:, :4]  # symbol -> class
    of_class = np.eye(5)[CLASS].T @ pairs @ into + 0.5
    of_class /= of_class.sum(1, keepdims=True)
    coarse = (of_class @ (into / into.sum(0)).T)[CLASS]
    first = (pairs + 0.5 * coarse) / (pairs.sum(1, keepdims=True) + 0.5)
    if order == 1:
        return np.log((1 - MIX[2]) * first + MIX[2] * coarse).astype(np.float32)
    second = (counts + 0.5 * first[None]) / (counts.sum(2, keepdims=True) + 0.5)
    return np.log(MIX[0] * second + MIX[1] * first[None] + MIX[2] * coarse[None]).astype(np.float32)


@dataclass(frozen=True)
class MarkovModel:
    """Log-probability tables of the random chains and of ordinary identifiers, and the cut."""

    random: dict[str, np.ndarray]
    ordinary: np.ndarray
    cut: float

    def ratios(self, tokens: list[str]) -> np.ndarray:
        """log P(token | random) - log P(token | ordinary); the random chains have equal shares."""
        if not tokens:
            return np.zeros(0)
        codes, begin = coded(tokens)
        one, two = contexts(codes, begin)

        def total(logs):
            return np.add.reduceat(logs.astype(np.float64), begin)

        each = np.stack([total(t[one, codes]) for t in self.random.values()])
        top = each.max(0)
        mixed = top + np.log(np.exp(each - top).mean(0))
        return mixed - total(self.ordinary[two, one, codes])

    def is_random(self, tokens: list[str], ratios: np.ndarray) -> np.ndarray:
        """Which tokens pass the cut, given their ratios."""
        sizes = np.array([len(t) for t in tokens])
        written_with = np.array([any(c.isalnum() for c in t) for t in tokens], bool)  # rules of dashes are no strings
        return written_with & (ratios > self.cut) & (ratios > LEAST_PER_SYMBOL * sizes)


def drawn(seed: int = 11) -> list[tuple[str, str]]:
    """(token, kind): uniform random strings of every alphabet in ALPHABETS, labelled by it."""
    rng = np.random.default_rng(seed)
    out = []
    for kind, letters in ALPHABETS.items():
        for size in rng.integers(LEAST_TOKEN, 64, GENERATED):
            out.append(("".join(letters[i] for i in rng.integers(0, len(letters), size)), kind))
    return out


def labelled_samples(
    docs: DataFrame, text: str = "text", documents: int = SAMPLE_DOCUMENTS, tokens: int = SAMPLE_TOKENS
) -> DataFrame:
    """(token, kind): distinct tokens of a bounded sample of documents, labelled by the base patterns.

    What a base pattern caught is labelled with the pattern's name (a random string), every other
    token of six characters or more is ordinary. The documents with the smallest hashes of
    their text are read, whole; at most ``tokens`` distinct tokens of each label are kept,
    those with the smallest hashes.
    """
    body = F.col(text).cast("string")
    texts = docs.select(body.alias("text"), F.xxhash64(body).alias("hash")).where("text is not null")
    chosen = texts.select("hash").distinct().orderBy("hash").limit(documents)
    few = texts.join(F.broadcast(chosen), "hash", "left_semi").select("text").distinct()

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            for t in batch.column(0).to_pylist():
                spans = base_spans(t)
                found = {(t[s:e], ORDINARY) for s, e in tokens_between(t, spans, 6)}
                for m in _ASSIGN.finditer(t):
                    if len(m[2]) >= LEAST_ASSIGN:
                        found.add((m[2].replace(".", "_"), BASE_KINDS[0]))
                found |= {(t[s:e], BASE_KINDS[k]) for s, k, e in spans if k}
                rows = sorted((x[:TOKEN_CHARS], kind) for x, kind in found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["token", "kind"]
                )

    found = written(few.mapInArrow(task, "token string, kind string").distinct(), "labelled-tokens")
    by_hash = [F.xxhash64("token"), F.col("token"), F.col("kind")]
    ordinary = found.where(F.col("kind") == ORDINARY).orderBy(*by_hash).limit(tokens)
    return ordinary.unionByName(found.where(F.col("kind") != ORDINARY).orderBy(*by_hash).limit(tokens))


def fit(samples: DataFrame, false_share: float = FALSE_SHARE, least_ratio: float = LEAST_RATIO, tokens: int = SAMPLE_TOKENS) -> MarkovModel:
    """Chains and cut from labelled samples (token, kind; kind ``ordinary`` or the kind of a random string).

    At most ``tokens`` samples of each label reach the driver, those with the smallest hashes. Strings drawn
    from known alphabets join the random ones. Every fifth ordinary token is held back; the cut is the ratio that a share
    of ``false_share`` of them exceeds, at least ``least_ratio``. Ordinary samples that the
    first fit takes for random strings (secrets that no pattern caught) are left out of the second.
    Nulls, empty tokens and tokens with other characters are ignored; the order of the rows and repeated rows do not count.
    """
    usable = samples.where(F.col("token").rlike(rf"^{_CLASS}+$") & F.col("kind").isNotNull()).select(
        F.substring("token", 1, TOKEN_CHARS).alias("token"), F.col("kind").cast("string").alias("kind")
    ).distinct()
    by_hash = [F.xxhash64("token"), F.col("token"), F.col("kind")]
    ordinary = [r["token"] for r in usable.where(F.col("kind") == ORDINARY).orderBy(*by_hash).limit(tokens).collect()]
    labelled = usable.where(F.col("kind") != ORDINARY).orderBy(*by_hash).limit(tokens).collect()
    kinds: dict[str, list[str]] = {}
    for token, kind in [*((r["token"], r["kind"]) for r in labelled), *drawn()]:
        kinds.setdefault(kind, []).append(token)
    chains = {kind: chain(kinds[kind], 1) for kind in sorted(kinds)}
    back, learned = ordinary[::5], [t for i, t in enumerate(ordinary) if i % 5]
    model = MarkovModel(chains, chain(learned, 2), least_ratio)
    learned = [t for t, r in zip(learned, model.ratios(learned)) if r < least_ratio]
    model = MarkovModel(chains, chain(learned, 2), least_ratio)
    back = [t for t in back if len(t) >= LEAST_TOKEN]
    ratios = np.sort(model.ratios(back))
    clear = ratios[ratios < 4 * least_ratio]  # beyond this, a held-back token is a secret that no pattern caught
    cut = float(clear[int((1 - false_share) * (len(clear) - 1))]) if len(clear) else least_ratio
    return MarkovModel(chains, model.ordinary, max(cut, least_ratio))


SPANS = T.ArrayType(
    T.StructType([
        T.StructField("kind", T.StringType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("end", T.LongType(), False),
        T.StructField("ratio", T.DoubleType()),
    ]),
    False,
)


def scan(docs: DataFrame, model: MarkovModel, text: str = "text", out: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """Add every finding of every whole text: array of (kind, start, end, ratio) by start, then kind.

    Code points, end exclusive. Base findings (kinds assign, access, hex; ratio null) are those of the fixed
    patterns, each kind leftmost and non-overlapping; kinds may overlap each other. Findings of kind markov are token runs
    of at least LEAST_TOKEN characters that touch no base finding and whose log-likelihood ratio exceeds the model's cut, and
    LEAST_PER_SYMBOL for each character.
    Null and empty texts have none; equal texts have equal findings; a column named like ``out`` is replaced.
    """
    shared = Shared(docs.sparkSession, model)

    def make():
        rate = shared.value

        def work(texts):
            found = [base_spans(t) if t else [] for t in texts]
            runs = [(i, s, e) for i, t in enumerate(texts) if t for s, e in tokens_between(t, found[i])]
            tokens = [texts[i][s:e] for i, s, e in runs]
            ratios = rate.ratios(tokens)
            rows = [[(s, k, e, None) for s, k, e in spans] for spans in found]
            for j in np.flatnonzero(rate.is_random(tokens, ratios)).tolist():
                i, s, e = runs[j]
                rows[i].append((s, len(BASE_KINDS), e, float(ratios[j])))
            names = [*BASE_KINDS, MARKOV]
            return [[[{"kind": names[k], "start": s, "end": e, "ratio": r} for s, k, e, r in sorted(x, key=lambda y: y[:3])] for x in rows]]

        return work

    return map_texts(docs, text, make, [T.StructField(out, SPANS, False)], keep)


def listed(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end of the findings, comma-joined; '' without any."""
    chosen = F.filter(spans, lambda x: x["kind"] != MARKOV) if base_only else spans
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
