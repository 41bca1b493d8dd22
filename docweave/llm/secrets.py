"""Secret scans: fixed patterns, and random strings told from ordinary identifiers by two character Markov models."""

from __future__ import annotations

import hashlib
import importlib
import inspect
import random
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Identifiers of this form name records; they are no keys.
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![A-Za-z0-9])")
# Words and abbreviations that names in programs are made of.
NAME_WORDS = (
    "access account action add address admin agent alloc amd android api app arch archive arg array async attr auth auto back base batch begin bin bit block body bool boot bounds box branch browser buffer build byte cache call cert char check child class clean click client clock close cloud cmd code collect color column command commit common compare config connect const content context control copy core count cpu create css ctx current "
    "data database date debug decode default delete deploy depth desc device dict dir disk display dns doc domain double down download driver edit element enable encode end engine entry env error event exec exit export factory fail fetch field file filter find first flag float flush font format free from func gateway get global graph group handler hash head header height host html icon idx image import index info init inner input insert install int item iter java job json kernel key "
    "label language last layer layout len level lib limit line link linux list load local lock log login loop mac main make manager map mask master match max memory merge message meta method min mobile mode model module mount mutex name net next node note null num object offset open option order out output owner page panel param parent parse patch path pixel plugin point pool port post prefix print process product profile program project proxy public python query queue "
    "random range rate read record ref refresh regex region register release remote remove render repo request reset resize resource response result retry return role root route row rule run sample scale schema scope screen script search section select send server service session set shape shared size slice socket sort source span spark stack start state static status step stop storage store stream string style submit sum swap switch sync system "
    "tab table tag target task temp template test text thread throw time title toggle tool top total trace track train tree type unit update upload url user util valid value variable vector version video view virtual wait web widget width win window word work worker write xml zip zone"
).split()
#: Modules whose names and documentation are samples of identifiers and of the words that people build them from.
LIBRARY = (
    "argparse ast asyncio bz2 calendar codecs collections concurrent.futures configparser copy csv ctypes datetime decimal difflib dis email.message errno fractions ftplib functools gettext heapq html.parser http.client "
    "http.cookiejar http.server imaplib inspect io ipaddress itertools json locale logging logging.handlers mailbox math mimetypes multiprocessing numpy numpy.linalg numpy.random operator os os.path pathlib pickle platform plistlib "
    "poplib pyarrow pyarrow.compute queue re sched select selectors shelve shutil signal smtplib socket socketserver sqlite3 ssl stat statistics string struct subprocess symtable tarfile tempfile textwrap threading time tokenize trace "
    "traceback types typing unicodedata unittest unittest.mock urllib.parse urllib.request uuid warnings wave weakref xml.dom.minidom xml.etree.ElementTree xml.sax zipfile zoneinfo"
).split()
#: Orders of characters that tables and tests write out.
SEQUENCES = (string.ascii_lowercase, string.ascii_uppercase, string.digits, "qwertyuiop", "asdfghjkl", "zxcvbnm", "QWERTYUIOP", "ASDFGHJKL", "ZXCVBNM", "0123456789abcdef", "0123456789ABCDEF")
_ALPHABET = string.ascii_letters + string.digits + "+/_=-."
_SEPARATORS = len(string.ascii_letters + string.digits)  # the codes from here on
_CODE = np.full(128, len(_ALPHABET), np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))


@dataclass(frozen=True)
class Settings:
    """The models are fitted on bounded samples: identifiers of ``sample_docs`` documents (of each at most ``sample_chars``
    characters), ``names`` names as programs have them, ``library`` names and words of installed modules, ``numbers`` drawn numbers (and a tenth as many sequences), ``random_strings`` drawn
    strings, and ``labelled`` rows of a table of labelled strings where one is given. The ordinary model is of second order, and falls back on the
    first with the weight of ``backoff`` characters; the random one is of first order, since what is random has no longer memory.

    A candidate is a run of at least ``min_chars`` characters of the alphabet, or a stretch of such a run; it is reported if its
    log-likelihood ratio reaches ``min_total`` in all and ``min_mean`` per character.
    """

    sample_docs: int = 400
    sample_chars: int = 20_000
    names: int = 6000
    random_strings: int = 4000
    numbers: int = 2000
    library: int = 60_000
    labelled: int = 20_000
    backoff: float = 5.0
    min_chars: int = 16
    min_total: float = 18.0
    min_mean: float = 1.0
    smoothing: float = 0.5
    seed: int = 5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping within each kind; code points, end exclusive."""
    low = text.lower()
    found = []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def random_sample(settings: Settings) -> list[str]:
    """Labelled positives: strings drawn from the alphabets that keys and tokens use."""
    draw = random.Random(settings.seed)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, "0123456789abcdef")
    return ["".join(draw.choices(alphabets[k % len(alphabets)], k=draw.randint(16, 44))) for k in range(settings.random_strings)]


def identifiers(text: str) -> list[str]:
    """Labelled negatives: the alphabet's runs of a text outside the fixed patterns, and joins of them as identifiers are built."""
    for start, end, _ in reversed(base_spans(text)):
        text = text[:start] + " " + text[end:]
    runs = [r for r in re.findall(r"[A-Za-z0-9+/_=.-]{3,}", text) if not (re.search(r"\d", r) and re.search(r"[A-Za-z]", r))]
    joined = [sep.join(runs[k : k + 3]) for k, sep in zip(range(0, len(runs) - 3, 3), "_-./" * len(runs))]
    camel = ["".join(w.capitalize() for w in runs[k : k + 3]) for k in range(0, len(runs) - 3, 9)]
    return runs + joined + camel


def names(words: list[str], settings: Settings) -> list[str]:
    """More labelled negatives: names of one to five words in the shapes that programs, files and versions have."""
    draw = random.Random(settings.seed + 2)

    def part() -> str:
        word = draw.choice(NAME_WORDS if draw.random() < 0.7 or not words else words)
        if draw.random() < 0.15:
            word = word[: draw.randint(1, 4)]
        return word + (draw.choice(["", "", "v"]) + str(draw.choice([2, 3, 8, 16, 32, 64, 128, 256, draw.randint(0, 99), draw.randint(1990, 2039)])) if draw.random() < 0.15 else "")

    out = []
    for k in range(settings.names):
        parts = [part() for _ in range(draw.randint(1, 5))]
        pascal = "".join(w.upper() if len(w) < 5 and draw.random() < 0.3 else w.capitalize() for w in parts)
        out.append((pascal, parts[0] + pascal[len(parts[0]) :], "_".join(parts), "_".join(parts).upper(), "-".join(parts), "/".join(parts), "_".join(w.capitalize() for w in parts), "-".join(["_".join(parts[:2]), *parts[2:], str(draw.randint(0, 2039))]))[k % 8])
    return out


def plain_numbers(settings: Settings) -> list[str]:
    """More labelled negatives: numbers as in accounts, telephones and dates, which are no keys."""
    draw = random.Random(settings.seed + 1)
    return [draw.choice(["", "-", "."]).join("".join(draw.choices(string.digits, k=draw.randint(2, 5))) for _ in range(draw.randint(1, 5))) for _ in range(settings.numbers)]


def library_names(settings: Settings) -> list[str]:
    """More labelled negatives: names of modules' members as they are, and the words of their documentation, alone and joined as in names."""
    found: dict[str, None] = {}
    words: list[str] = []
    for module in map(importlib.import_module, LIBRARY):
        members = [getattr(module, n, None) for n in dir(module)]
        own = [m for m in members if inspect.isclass(m) or inspect.isroutine(m)]
        for names_ in (dir(module), *(dir(m) for m in own if inspect.isclass(m))):
            found.update(dict.fromkeys(n.strip("_") for n in names_ if n.isascii()))
        for thing in (module, *own):
            doc = getattr(thing, "__doc__", None)
            words += re.findall(r"[A-Za-z]{3,}", doc) if isinstance(doc, str) else []
    draw = random.Random(settings.seed + 3)
    out = sorted(n for n in found if len(n) > 2)
    draw.shuffle(out)
    out = out[: settings.library // 3]
    while len(out) < settings.library and words:
        few = draw.choices(words, k=draw.randint(1, 5))
        out.append(draw.choice((" ", "")).join(w.capitalize() for w in few).replace(" ", draw.choice("_-./")) if draw.random() < 0.6 else draw.choice("_-./").join(few).lower())
    return out


def sequences(settings: Settings) -> list[str]:
    """More labelled negatives: SEQUENCES, a few in a row."""
    draw = random.Random(settings.seed + 4)
    return ["".join(draw.choices(SEQUENCES, k=draw.randint(1, 4))) for _ in range(settings.numbers // 10)]


def labelled_sample(labelled: DataFrame | None, settings: Settings) -> tuple[list[str], list[str]]:
    """(secrets, ordinary) of a table (value, secret): its ``labelled`` rows of least hash. Null values and labels are left out, and characters outside of the alphabet part strings."""
    if labelled is None:
        return [], []
    rows = labelled.where("value is not null and secret is not null").orderBy(F.xxhash64(F.lit(settings.seed), F.col("value"))).limit(settings.labelled).select("value", "secret").collect()
    parts = lambda want: [x for r in rows if bool(r["secret"]) == want for x in re.findall(r"[A-Za-z0-9+/_=.-]+", r["value"])]
    return parts(True), parts(False)


def transitions(strings: Iterable[str], smoothing: float, backoff: float | None = None) -> np.ndarray:
    """Log probabilities of a character after two others (the last code: before the start); of the last one alone without backoff."""
    n = len(_ALPHABET)
    codes = _CODE[np.frombuffer(("\0\0" + "\0\0".join(strings)).encode("ascii"), np.uint8)]
    before, last, now = codes[:-2], codes[1:-1], codes[2:]
    real = now < n
    one = np.full((n + 1, n), smoothing)
    np.add.at(one, (last[real], now[real]), 1)
    one /= one.sum(axis=1, keepdims=True)
    if backoff is None:
        return np.broadcast_to(np.log(one), (n + 1, n + 1, n))
    two = np.zeros((n + 1, n + 1, n))
    np.add.at(two, (before[real], last[real], now[real]), 1)
    return np.log((two + backoff * one) / (two.sum(axis=2, keepdims=True) + backoff))


def fit(docs: DataFrame, settings: Settings, labelled: DataFrame | None = None) -> np.ndarray:
    """Log ratios of both models, random over ordinary. docs has doc_id and text; the sample is the documents of least hash. labelled: see labelled_sample().

    A bound on the hash, from the number of rows, leaves about four times the sample to be sorted, however many tasks read.
    """
    span = 1 << 40
    most = min(1.0, 4 * settings.sample_docs / max(1, docs.count())) * span
    rank = F.pmod(F.xxhash64(F.lit(settings.seed), F.col("doc_id"), F.col("text")), F.lit(span))
    few = docs.select(F.substring("text", 1, settings.sample_chars).alias("text"), rank.alias("rank")).where((F.col("rank") <= F.lit(int(most))) & (F.length("text") > 0))
    sample = few.orderBy("rank").limit(settings.sample_docs).select("text").collect()
    drawn = [s for r in sample for s in identifiers(r["text"])]
    words = [s.lower() for s in drawn if s.isalpha() and 3 <= len(s) <= 12]
    secret, plain = labelled_sample(labelled, settings)
    ordinary = drawn + names(words, settings) + library_names(settings) + plain_numbers(settings) + sequences(settings) + plain
    return transitions(random_sample(settings) + secret, settings.smoothing) - transitions(ordinary, settings.smoothing, settings.backoff)


def stretches(scores: np.ndarray, codes: np.ndarray, settings: Settings) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run: the whole run, or else its best stretch and those on both sides of it.

    The best stretch of at least min_chars has the largest sum above min_mean per character; as it is chosen among many, its total
    must also exceed min_total by the logarithm of the run's length. It is drawn out to the nearest of / = _ - + where it still holds.
    """
    out, todo = [], [(0, len(scores))]
    while todo:
        first, end = todo.pop()
        n = end - first
        if n < settings.min_chars:
            continue
        sums = np.concatenate([[0.0], np.cumsum(scores[first:end])])
        if n == len(scores) and sums[-1] >= settings.min_total and sums[-1] >= settings.min_mean * n:
            return [(0, n)]
        above = sums - settings.min_mean * np.arange(n + 1)
        least = np.minimum.accumulate(above[: n - settings.min_chars + 1])
        stop = int(np.argmax(above[settings.min_chars :] - least)) + settings.min_chars
        start = int(np.argmin(above[: stop - settings.min_chars + 1]))
        if above[stop] < above[start]:
            continue
        if sums[stop] - sums[start] >= settings.min_total + np.log(len(scores)):
            low, high = start, stop
            while low > 0 and codes[first + low - 1] < _SEPARATORS:
                low -= 1
            while high < n and codes[first + high] < _SEPARATORS:
                high += 1
            start = low if above[stop] >= above[low] else start
            stop = high if above[high] >= above[start] else stop
            out.append((first + start, first + stop))
            todo += [(first, first + start), (first + stop, end)]
    return out


def random_spans(text: str, ratios: np.ndarray, settings: Settings, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Stretches of runs that are more likely random than ordinary; the spans already taken and UUIDs are cut out of the runs."""
    out, taken = [], sorted(taken + [(*m.span(), "uuid") for m in UUID.finditer(text)])
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % settings.min_chars, text):
        pieces, at = [], m.start()
        for start, end, _ in taken:
            if start < m.end() and m.start() < end:
                pieces.append((at, start))
                at = max(at, end)
        for start, end in [*pieces, (at, m.end())]:
            if end - start >= settings.min_chars:
                codes = _CODE[np.frombuffer(text[start:end].encode("ascii"), np.uint8)]
                start_code = len(_ALPHABET)
                scores = ratios[np.concatenate([[start_code, start_code], codes[:-2]]), np.concatenate([[start_code], codes[:-1]]), codes]
                out += [(start + a, start + b, "random") for a, b in stretches(scores, codes, settings)]
    return sorted(out)


def scanner(ratios: np.ndarray, settings: Settings):
    """Batches of (doc_id, text) to counts and spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = random_spans(text, ratios, settings, base)
                counts.append([sum(s[2] == kind for s in base) for kind in KINDS[:3]])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan


def secrets(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans; one pass without a shuffle after the fit.

    labelled is a table of strings (value, secret) that the models are fitted on besides the samples that every fit has.

    Null and empty texts have no spans; every row, repeated or not, with whatever id, has its own result; very long texts are scanned whole.
    Spans that start at one place (ties) are listed by kind. Other columns aren't looked at. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ratios = fit(rows, settings, labelled)
    return rows.mapInArrow(scanner(ratios, settings), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
