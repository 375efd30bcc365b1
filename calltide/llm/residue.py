"""Problem 10: template residue, filler, error pages and script notices, by positive-unlabelled naive Bayes.

A text is split into passages (lines and sentences). What a text quotes or shows as code (quoted spans, code spans, shell
and log lines) is replaced by a mark first, as it isn't the text's own content. A few trusted passages are known to be
residue: whole messages and marks that occur nowhere else. All others are unlabelled. Expectation-maximization starts
from trusted = residue, rest = content, then lets unlabelled passages join by their posterior and fits word and mark
frequencies of both classes to all passages again, until the share of residue stands still. Rounds run over the distinct
passages with their numbers of occurrences, and weights are whole multiples of 2^-20, so sums don't depend on the order
of rows. Decisions are the model's alone: what is trusted starts the training and adds nothing to a score. A record is
residue if one of its passages is.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm.words import INVISIBLE
from calltide.runtime import cut, release

#: Features are hashed to so many numbers; model and counts are vectors of this length.
DIMENSIONS = 1 << 16
#: Rounds end when the weight of residue changes by less than this part of it; if that takes more than so many, training raises.
TOLERANCE = 1e-3
MOST_ROUNDS = 500
#: Weights of passages are whole numbers of this part.
UNIT = 1 / (1 << 20)
#: Distinct passages whose features a task remembers.
REMEMBERED = 100_000
#: Features' worth of the whole corpus that is mixed into either class.
SMOOTHING = 500.0
#: An unlabelled passage joins residue by its posterior after this much is taken off its log-odds, and only with so many features; else short, common phrases are drawn in.
JOIN_MARGIN, JOIN_FEATURES = 4.0, 5
#: Words and pairs of words say much the same, so their sum counts by this factor only.
EVIDENCE = 0.5
#: Log-odds from which a passage counts as residue.
THRESHOLD = 0.0

#: Trusted messages, in the languages of the corpus. A passage is trusted if it begins with one of them.
TRUSTED_BEGINNINGS = (
    "lorem ipsum",
    "404 not found", "not found", "page not found", "403 forbidden", "forbidden", "access denied", "internal server error",
    "500 internal server error", "502 bad gateway", "bad gateway", "service unavailable", "503 service unavailable",
    "504 gateway timeout", "gateway timeout", "your session has expired", "session expired", "service under maintenance",
    "something went wrong", "could not connect to the database", "error establishing a database connection", "this site cannot be reached", "the page you are looking for", "an unexpected error occurred",
    "zugriff verweigert", "seite nicht gefunden", "der dienst ist zurzeit nicht", "die seite wurde nicht gefunden",
    "accès refusé", "l'accès est refusé", "page introuvable", "la page demandée n'existe pas", "erreur interne du serveur",
    "acceso denegado", "página no encontrada", "la página solicitada no existe", "error interno del servidor",
    "please enable javascript", "enable javascript", "javascript is disabled", "javascript is required", "you need to enable javascript",
    "bitte aktivieren sie javascript", "veuillez activer javascript", "active javascript", "por favor active javascript", "checking your browser", "noscript:",
    "your text here", "your text goes here", "insert text here", "sample text", "placeholder text", "replace this text", "replace this paragraph",
    "texte à remplacer", "hier steht später", "coming soon", "click to edit", "texto de ejemplo", "tbd tbd", "xxx xxx", "blah blah", "asdf asdf",
)

#: Words of the usual pseudo-Latin filler. A passage of four or more words is trusted if six in ten are of these.
FILLER_WORDS = frozenset((
    "adipiscing", "aliqua", "aliquam", "amet", "ante", "arcu", "at", "auctor", "augue", "bibendum", "commodo", "condimentum",
    "consectetur", "consequat", "cras", "cursus", "dapibus", "diam", "dictum", "dolor", "dolore", "donec", "duis", "egestas", "eget",
    "eiusmod", "elementum", "elit", "enim", "erat", "eros", "est", "et", "etiam", "eu", "euismod", "facilisis", "faucibus", "felis",
    "fermentum", "feugiat", "fringilla", "fusce", "gravida", "iaculis", "id", "imperdiet", "incididunt", "ipsum", "justo", "labore",
    "lacinia", "lacus", "laoreet", "lectus", "leo", "libero", "ligula", "lorem", "luctus", "maecenas", "magna", "massa", "mattis",
    "mauris", "metus", "mi", "mollis", "morbi", "nam", "nec", "neque", "nibh", "nisi", "nisl", "non", "nulla", "nullam", "nunc", "odio",
    "orci", "ornare", "pellentesque", "pharetra", "phasellus", "placerat", "porta", "porttitor", "posuere", "praesent", "pretium",
    "pulvinar", "purus", "quam", "quis", "rhoncus", "risus", "rutrum", "sagittis", "sapien", "scelerisque", "sed", "sem", "semper", "sit",
    "sodales", "sollicitudin", "suscipit", "suspendisse", "tellus", "tempor", "tempus", "tincidunt", "tortor", "tristique", "turpis",
    "ullamcorper", "ultrices", "urna", "ut", "varius", "vehicula", "vel", "velit", "venenatis", "vestibulum", "vitae", "vivamus",
    "volutpat", "vulputate",
))
FILLER_SHARE = 0.6
#: Marks in the codes of words.
_PLAIN, _FILLER = 1 << 40, 1 << 41
#: Forms of trusted messages.
_TRUSTED_FORM = re.compile(
    r"(?:http |status |error |code )?(?:error |status |code )?[45]\d\d ?[.:|-]|(?:insert|type|write|put|paste|add|enter) [\w ]{2,40} (?:here|below this line|in this (?:box|place|field))\b"
    r"|(?:oops|sorry|failure|error) ?[!:,-]|your session (?:has|is)\b|access to [\w ]{2,30} denied\b|(?:this )?method (?:is )?not allowed|loading ?(?:\.\.\.|…).*scripts?\b|your browser (?:is too old|does not support|has)\b"
    r"|(?:please |kindly |you (?:have|need) to )?(?:enable|allow|activate|turn on|switch on) (?:java ?script|js|scripts|(?:client-side |active )?scripting|script execution)\b"
)
#: Marks which a template fills in, as text shows them when it wasn't filled in.
SLOT = re.compile(
    r"\{\{\s*[\w .]+\s*\}\}|\$\{\s*\w+\s*\}|#\{\s*\w+\s*\}|<%=?\s*[\w .]+\s*%>|%\(\w+\)[sd]|%[A-Za-z][A-Za-z_]+%|\$[A-Za-z][A-Za-z_]*\$"
    r"|<<\s*\w[\w ]*>>|&lt;\s*\w[\w ]*&gt;|__[A-Za-z]\w*?__|@@\w+@@|\[(?:INSERT|ENTER|YOUR|ADD)\b[^\]]{0,60}\]|\[\[\s*\w[\w ]*\]\]"
    r"|<[A-Z][A-Z]+(?: [A-Z]+)*>|\[[A-Z][a-z]+(?: [A-Z][a-z]+)*\]|(?<![\w$#%{])\{[A-Za-z_]\w*\}(?!\})"
)
_CODE_SPAN = re.compile(r"```.*?```|`[^`\n]*`", re.S)
_QUOTED = re.compile(r"\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|„[^“”\n]{1,200}[“”]|«[^»\n]{1,200}»")
#: Lines that are code, commands, assignments or log output rather than sentences.
_CODE_LINE = re.compile(
    r"^(?: {4,}|\t)|^\s*(?:export|cp|mv|cd|rm|ls|cat|echo|srun|mpirun|module|source|set|if|for|while|return|print|import|from|def|int|char|const)\s[^.!?]*[=$;()/|-]"
    r"|^\s*\w+\(.*\);?\s*$|^\s*[A-Za-z_]\w*=\S|^\s*\[\d[\d.:]*\]\s|^\s*0x[0-9a-f]+\s|^\s*(?:INFO|WARN|DEBUG|TRACE)\b|^\s*(?:ERROR|WARNING)\s+[a-z]|^\s*[{\[]\s*\"\w+\"\s*:|^\s*\d+: \w+ of \d+|^\s*[$>#] \w+ .*[-/]"
)
_ODD = re.compile(r"[\"“„«{}$#<>%&_@\[\]]")
_PREFIX = re.compile(r"^[\s>|#*-]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?![a-zà-ÿ])")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\x01\w+")
_DIGITS = str.maketrans("123456789", "000000000")
_ZEROS = re.compile("00+")
_TAG = re.compile(r"</?(?:html|head|title|body|h1|h2|p|div|noscript|center|hr)\b[^>]*>", re.I)
_INVISIBLE = re.compile(f"[{INVISIBLE}]")


def passages(text: str) -> list[str]:
    """The passages of a text, with quotes, code and fill-in marks replaced by marks that begin with \\x01."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "`" in text:
        text = _CODE_SPAN.sub(" \x01code ", text)
    lines: list[str] = []
    for line in text.splitlines():
        end = line.rstrip()
        if not end or _CODE_LINE.match(line) or (end[-1] == ";" and not end.endswith(("&lt;", "&gt;"))):
            continue
        if _ODD.search(line):  # most lines have no sign that these look for
            line = SLOT.sub(" \x01slot ", _TAG.sub(" ", _QUOTED.sub(" \x01quote ", line)))
        line = _PREFIX.sub("", line).strip()
        if lines and line[:1].islower() and lines[-1][-1:] not in ".!?:":
            lines[-1] += " " + line  # a sentence that was wrapped
        else:
            lines.append(line)
    return [p for line in lines for p in _SENTENCE.split(line) if p]


class Features:
    """Hashed features of passages: words, neighbouring words, marks, and a fact about their form.

    Hashes of words are remembered, as there are far fewer of them than passages.
    """

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def _code(self, token: str) -> int:
        """A word's hash from 1 on, with marks for words and for filler words; negative for numbers."""
        c = self.codes.get(token)
        if c is None:
            if len(self.codes) > 500_000:
                self.codes.clear()
            if token.isdigit():  # numbers have no word feature, only pairs with their neighbours
                c = -1 - zlib.crc32(b"#")
            else:
                c = 1 + zlib.crc32((token if len(token) < 40 else "\x02long").encode())
                c |= (_PLAIN if token[0] != "\x01" else 0) | (_FILLER if token in FILLER_WORDS else 0)
            self.codes[token] = c
        return c

    def of(self, passages: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """The sorted feature numbers of each passage, none for one without words; and whether it is pseudo-Latin filler."""
        tokens = [_TOKEN.findall(p.lower()) for p in passages]
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        signed = np.fromiter((self._code(t) for ts in tokens for t in ts), np.int64, int(lengths.sum()))
        h, owner = np.abs(signed) & (_PLAIN - 1), np.repeat(np.arange(len(tokens)), lengths)
        single = signed > 0
        words = (h * 0x9E3779B1 & 0xFFFFFFFF) >> 16
        follows = owner[1:] == owner[:-1]
        pairs = ((h[:-1] * 0x85EBCA6B + h[1:] * 0xC2B2AE35 + 0x27D4EB2F) & 0xFFFFFFFF) >> 16
        own = _distinct(owner[single] * DIMENSIONS + words[single])
        many, different = np.bincount(owner[single], minlength=len(tokens)), np.bincount(own // DIMENSIONS, minlength=len(tokens))
        repeats = np.flatnonzero((many >= 3) & (different * 2 <= many))
        every = _distinct(np.concatenate([own, owner[1:][follows] * DIMENSIONS + pairs[follows], repeats * DIMENSIONS + DIMENSIONS - 1]))
        ends = np.searchsorted(every, np.arange(1, len(tokens)) * DIMENSIONS)
        plain = np.bincount(owner[single & (signed & _PLAIN > 0)], minlength=len(tokens))
        latin = (plain >= 4) & (np.bincount(owner[single & (signed & _FILLER > 0)], minlength=len(tokens)) >= FILLER_SHARE * plain)
        return (np.split((every % DIMENSIONS).astype(np.int32), ends) if len(tokens) else []), latin


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def without_numbers(passage: str) -> str:
    """The passage with every number replaced by 0."""
    out = passage.translate(_DIGITS)
    return _ZEROS.sub("0", out) if "00" in out else out


#: The first words of the trusted forms.
_FORM_WORDS = (
    "http", "status", "error", "code", "4", "5", "insert", "type", "write", "put", "paste", "add", "enter", "oops", "sorry", "failure", "your", "access",
    "this", "method", "loading", "please", "kindly", "you", "enable", "allow", "activate", "turn", "switch",
)


class Trust:
    """Whether a passage is known to be residue, but for filler; most passages are told by their first letters."""

    def __init__(self, beginnings: Sequence[str] = TRUSTED_BEGINNINGS):
        self.beginnings = tuple(beginnings)
        self.first = {w[:2] for w in (*beginnings, *_FORM_WORDS)}

    def __call__(self, passage: str) -> bool:
        if "\x01slot" in passage:
            return True
        start = passage[:2].lower()
        if start not in self.first and start[:1] not in self.first and not start[:1].isspace():
            return False
        low = " ".join(passage.lower().replace("’", "'").split())
        return low.startswith(self.beginnings) or bool(_TRUSTED_FORM.match(low))


def passage_table(docs: DataFrame, doc_id: str, text: str, beginnings: tuple[str, ...] = TRUSTED_BEGINNINGS) -> DataFrame:
    """doc_id, passage (number), feats and trusted for every passage of every text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        features, trusted = Features(), Trust(beginnings)
        for b in batches:
            rows = [(i, k, p) for i, t in enumerate(b.column("_text").to_pylist()) for k, p in enumerate(passages(t))]
            if len(known) > REMEMBERED:
                known.clear()
            met: dict[str, tuple] = {}
            # numbers don't matter to features, so many passages have been met before
            same = {p: without_numbers(p) for p in dict.fromkeys(r[2] for r in rows)}
            new = [s for s in dict.fromkeys(same.values()) if s not in known]
            known.update(zip(new, zip(*features.of(new))))
            for p, s in same.items():
                f, latin = known[s]
                met[p] = (f, bool(latin) or trusted(p)) if len(f) else None
            out = [(i, k, *m) for i, k, p in rows if (m := met[p])]
            feats = [r[2] for r in out]
            ends = np.cumsum([0, *map(len, feats)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array([r[0] for r in out], pa.int64())),
                    pa.array([r[1] for r in out], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *feats]))),
                    pa.array([r[3] for r in out], pa.bool_()),
                ],
                names=["doc_id", "passage", "feats", "trusted"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).filter("_text is not null")
    return rows.mapInArrow(scan, f"doc_id {dict(docs.dtypes)[doc_id]}, passage int, feats array<int>, trusted boolean")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, one after another, and the lengths of the lists."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


class Model:
    """Log-odds of every feature, and of residue beforehand."""

    def __init__(self, weights: np.ndarray, prior: float):
        self.weights, self.prior = weights, prior

    @classmethod
    def fit(cls, residue: np.ndarray, every: np.ndarray, n_residue: float, n_all: float) -> Model:
        share = min(max(n_residue / max(n_all, 1), 1e-6), 0.5)
        # both classes are smoothed by all passages: a feature that residue never showed speaks against it, however rare
        common = every / max(every.sum(), 1) * SMOOTHING
        rest = np.maximum(every - residue, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            weights = np.log((residue + common) / (residue.sum() + SMOOTHING)) - np.log((rest + common) / (rest.sum() + SMOOTHING))
        weights[every == 0] = 0  # features never seen say nothing
        return cls(weights, float(np.log(share / (1 - share))))

    def log_odds(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For passages whose features are lists of these lengths in ``flat``; none is empty."""
        return np.add.reduceat(self.weights[flat], np.concatenate([[0], np.cumsum(lengths)[:-1]])) * EVIDENCE + self.prior

    def membership(self, flat: np.ndarray, lengths: np.ndarray, known: np.ndarray) -> np.ndarray:
        odds = np.clip(self.log_odds(flat, lengths) - JOIN_MARGIN, -500, 500)
        return np.where(known, 1.0, np.where(lengths >= JOIN_FEATURES, 1 / (1 + np.exp(-odds)), 0.0))


def train(table: DataFrame) -> tuple[Model | None, int]:
    """The model fitted to all passages, and the rounds it took. None without trusted passages: then nothing is known.

    All passages count; equal ones stand once, with their number.
    """
    spark = table.sparkSession
    distinct = cut(table.groupBy("feats", "trusted").agg(F.count("*").alias("n")), "distinct-passages")

    def counts(model: Model | None) -> tuple[np.ndarray, np.ndarray, float, float]:
        shared = spark.sparkContext.broadcast(model)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pos, every = np.zeros(DIMENSIONS + 1, np.int64), np.zeros(DIMENSIONS + 1, np.int64)
            for b in batches:
                if not len(b):
                    continue
                known, n = b.column("trusted").to_numpy(zero_copy_only=False), b.column("n").to_numpy()
                flat, lengths = _lists(b.column("feats"))
                weight = known.astype(float) if shared.value is None else shared.value.membership(flat, lengths, known)
                weight = np.rint(weight / UNIT).astype(np.int64) * n
                np.add.at(pos, flat, np.repeat(weight, lengths))
                np.add.at(every, flat, np.repeat(n, lengths))
                pos[-1] += weight.sum()
                every[-1] += n.sum()
            used = np.nonzero(every)[0]
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(pos[used]), pa.array(every[used])], names=["f", "pos", "every"])

        sums = distinct.mapInArrow(scan, "f int, pos bigint, every bigint").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("every").alias("every"))
        got = sums.toPandas()  # at most DIMENSIONS + 1 rows
        shared.unpersist()
        pos, every = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
        pos[got["f"]], every[got["f"]] = got["pos"] * UNIT, got["every"]
        return pos[:-1], every[:-1], pos[-1], every[-1]

    try:
        pos, every, n_pos, n_all = counts(None)
        if not n_pos:
            return None, 0
        for k in range(1, MOST_ROUNDS + 1):
            model = Model.fit(pos, every, n_pos, n_all)
            pos, every, now, n_all = counts(model)
            if abs(now - n_pos) <= TOLERANCE * n_pos:
                return Model.fit(pos, every, now, n_all), k
            n_pos = now
        raise RuntimeError(f"the share of residue still moves after {MOST_ROUNDS} rounds")
    finally:
        release(distinct)


def score_passages(table: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, passage and its log-odds of being residue."""
    if model is None:
        return table.select("doc_id", "passage", "trusted", F.lit(float("-inf")).alias("log_odds"))
    shared = table.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                odds = shared.value.log_odds(*_lists(b.column("feats")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("passage"), b.column("trusted"), pa.array(odds)], names=["doc_id", "passage", "trusted", "log_odds"])

    kind = dict(table.dtypes)["doc_id"]
    return table.mapInArrow(scan, f"doc_id {kind}, passage int, trusted boolean, log_odds double")


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, beginnings: tuple[str, ...] = TRUSTED_BEGINNINGS) -> DataFrame:
    """doc_id, score (highest log-odds of a passage), n_passages, n_residue and rounds (of the training) of every text that has passages.

    Null and empty texts, and texts of code and marks only, have no passages and aren't given. Without any trusted passage
    all scores are -infinity. Rows that repeat an id are judged together; a null id forms one record. Texts are read
    whole. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    table = cut(passage_table(docs, doc_id, text, beginnings), "passages")
    model, rounds = train(table)
    scored = score_passages(table, model)
    return scored.groupBy("doc_id").agg(
        F.max("log_odds").alias("score"), F.count("*").alias("n_passages"), F.sum((F.col("log_odds") >= threshold).cast("int")).alias("n_residue"), F.lit(rounds).alias("rounds")
    )
