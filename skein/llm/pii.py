"""Personal data: base patterns, and more spans from a conditional random field over word shapes.

The field labels the tokens of a line (letters, digits or one other character) as outside, or as the
beginning or inside of an email, ip, card or phone. It is trained on a small labelled table (by default the one that
``labelled_lines`` writes by rule), so it finds forms that the patterns do not: phones without a
plus sign, cards with other separators, emails with ``at`` and ``dot`` written out, bracketed or spaced
addresses. A span that it adds must have the number of digits (cards: also the check digit) or parts of its kind and overlap no base
span.

Only stretches around digits, at signs, opening brackets and the word ``dot`` are labelled, each within its line:
no form of the four kinds lacks them all. A stretch that ends inside a word takes in the rest of it, up to 400 characters in all to the left
and 4,000 to the right: longer words, junk, are seen in part by the field, never by the base patterns.

Superscripts, circled numbers and fractions are not digits; decimal digits of any script are.

Cases: a null text counts as empty, with the hash of an empty string and no span; repeated rows each
get their row; positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import id_text, read_table, slices
from skein.llm.crf import Crf, train, viterbi

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{x}-{k}" for k in KINDS for x in "BI")]
LONGEST = 4096  # tokens; a longer stretch is labelled in parts
OVERLAP = 512  # tokens that consecutive parts share; a span counts in the part that sees it farther from its edges
REACH = 48  # characters of its line that a stretch takes in on each side of a hint

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    # Each at sign in turn, with the run of local characters before it: linear however long runs are.
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _local:
            lo -= 1
        m = _domain.match(text, at) if lo < at else None
        if m:
            out.append(("email", lo, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind as listed, then start."""
    out = _emails(text)
    out += [("ip", *m.span()) for m in _ip.finditer(text) if max(len(p.lstrip("0")) for p in m[0].split(".")) < 4 and max(map(int, m[0].split("."))) <= 255]
    for m in _card.finditer(text):
        digits = _not_digit.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _phone.finditer(text) if 9 <= len(_not_digit.sub("", m[0])) <= 15]
    return out


# --- the field ---------------------------------------------------------------------------------

_token = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_hint = re.compile(r"[0-9@\[(]")
_dot = re.compile(r"\b[dD][oO][tT]\b")
# A written-out address, to which a span found is trimmed: at sign with blanks, bracketed at, or at with dot.
_name, _host = r"[\w%+-]+(?:(?:\.|\s+dot\s+)[\w%+-]+)*", r"(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)"
_written = re.compile(rf"(?i){_name}(?:(?:\s?@\s?|\s*[\[(]\s*at\s*[\])]\s*)[\w-]+(?:{_host}[\w-]+)+|\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)+)")
WORDS = frozenset("at dot com org net example mail phone tel call card ip address email number reach telefon handy appel correo mobile telefono teléfono portable write contact visa karte tarjeta paid host server from".split())


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Letters, digits, or one other character, with places."""
    return [(m[0], *m.span()) for m in _token.finditer(text)]


def _shape(tok: str) -> str:
    if tok.isdecimal():
        return "d" * min(len(tok), 7)
    if tok.isalpha():
        return "w:" + low if (low := tok.lower()) in WORDS else ("A" if tok[0].isupper() else "a") + ("+" if len(tok) > 3 else "")
    return tok


def features(toks: list[tuple[str, int, int]]) -> list[list[str]]:
    """Names of the shape features of each token: its own, its neighbours', the gap before it."""
    shapes = ["^^", "^", *(_shape(t) for t, _, _ in toks), "$", "$$"]
    out = []
    for i, (tok, a, _) in enumerate(toks):
        p2, p, s, n, n2 = shapes[i : i + 5]
        gap = "j" if i and toks[i - 1][2] == a else "s"
        after = "j" if i + 1 < len(toks) and toks[i + 1][1] == toks[i][2] else "s"
        small = "le255" if tok.isdecimal() and len(tok) < 4 and int(tok) < 256 else "no"
        out.append([f"0{s}", f"-{p}", f"+{n}", f"-0{p}{gap}{s}", f"0+{s}{after}{n}", f"-+{p}{gap}{after}{n}", f"--{p2}{p}{s}", f"++{s}{n}{n2}", f"8{small}{gap}{after}"])
    return out


def labelled_lines(seed: int = 7, n: int = 600) -> list[list[tuple[str, str | None]]]:
    """A small labelled table written by rule from a fixed seed: lines as (text, kind or None) parts."""
    rng = random.Random(seed)
    pick = rng.choice
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    word = lambda: "".join(pick("abcdefghiklmnoprstuv") for _ in range(rng.randint(2, 9)))
    cues = {"phone": "phone tel call number mobile handy telefon telefono portable".split(), "email": "mail email write contact correo".split(), "card": "card visa karte tarjeta paid".split(), "ip": "ip host server address from".split()}

    def words() -> str:
        made = [word() for _ in range(rng.randint(0, 5))]
        if made and rng.random() < 0.4:
            made[0] = made[0].title()
        return " ".join(made) + pick(["", "", "", ",", ".", ":"])

    def card() -> str:
        body = pick("3456") + digits(14)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        return pick(["", " ", "-", ".", "  ", "/"]).join(full[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        name = pick([[word()], [word(), digits(2)], [word(), word()], [word()[0], word()]])
        host = [pick([word(), f"mail{digits(1)}", f"{word()}-{word()}"]), pick(["com", "org", "net", "de", "es", "fr", "io", "co"])]
        if rng.random() < 0.2:
            host.insert(0, word())
        plain, spoken = lambda x: ".".join(x), lambda x: pick([" dot ", " [dot] ", " (dot) "]).join(x)
        form = rng.randrange(6)
        if form == 0:
            return f"{plain(name)}@{plain(host)}"
        if form == 1:
            return f"{plain(name)} @ {plain(host)}"
        if form == 2:
            return f"{pick([plain, '_'.join, spoken])(name)} at {' dot '.join(host)}"
        if form == 3:
            return f"{plain(name)}(at){plain(host)}"
        return f"{pick([plain, '_'.join])(name)} {pick(['[at]', '(at)'])} {pick([plain, spoken, spoken])(host)}"

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        sep = pick([" ", " ", "-", "."])
        sizes = pick([(3, 3, 3), (2, 2, 2, 2), (4, 4, 4), (3, 4, 4), (3, 3, 2, 2), (4, 3, 4), (2, 3, 2, 2), (4, 7), (3, 8)])
        grouped = sep.join(["0" + digits(sizes[0] - 1), *map(digits, sizes[1:])] if rng.random() < 0.6 else map(digits, sizes))
        pairs = "0" + digits(1) + "".join(sep + digits(2) for _ in range(4))
        area = "0" + digits(rng.randint(2, 3))
        slash = area + pick(["/", " / ", "-"]) + pick([digits(7), f"{digits(3)} {digits(2)} {digits(2)}", f"{digits(4)} {digits(4)}"])
        return pick([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"({area}) {digits(4)} {digits(4)}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"{a} {b} {c}", f"00{digits(2)} {a} {b}{digits(3)}", grouped, grouped, pairs, slash, slash])

    def ip() -> str:
        return pick([".", " . ", "[.]"]).join(str(rng.randint(0, 255)) for _ in range(4))

    def other() -> str:
        a = digits(1)
        thousands = lambda k: f"{rng.randint(1, 999)}" + "".join(f" {pick(['000', '500', digits(3)])}" for _ in range(k))
        return pick([
            f"20{digits(2)}-0{a}-1{a}", f"1{a}:3{a}", f"{a}.{digits(1)}.{digits(1)}", f"{digits(2)} %", f"${digits(3)}.{digits(2)}", f"19{digits(2)}", digits(rng.randint(1, 12)), f"{digits(3)},{digits(3)}",
            f"{word()}{digits(3)}", f"at {word()}", f"{digits(2)}/{digits(2)}/20{digits(2)}", f"v{a}.{a}.{digits(2)}", f"{digits(1)}-{digits(1)}", f"{digits(3)}-{digits(2)}", f"at {digits(2)}", f"{word()} at {word()} {word()}",
            f"{digits(4)} {word()}", "".join(pick("0123456789abcdef") for _ in range(20)), thousands(1), thousands(1), thousands(2), f"from {thousands(1)} to {thousands(2)}", f"97{a}-{a}-{digits(2)}-{digits(6)}-{a}", f"{a}-{digits(3)}-{digits(5)}-{a}",
            f"20{digits(6)}-{digits(4)}-{digits(4)}", f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(2)}", f"{digits(2)}-{digits(2)}, {digits(2)}-{digits(2)}, {digits(2)}-{digits(2)}", f"{digits(2)}.{a}, {a}.{digits(2)} and {digits(2)}.{digits(2)}",
            f"0{a}.0{a}.20{digits(2)}", f"dot at {word()}", f"the dot on {word()}", f"{word()} at {word()} (at {word()})", f"1{a}{a}0x{digits(3)}0", f"19{digits(2)} to 19{digits(2)} {word()} {thousands(2)}",
        ])

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    lines = []
    for _ in range(n):
        line: list[tuple[str, str | None]] = [(words() + " ", None)]
        for _ in range(rng.randint(0, 2)):
            kind = pick(["email", "ip", "card", "phone", "phone", None, None, None, None])
            if kind and rng.random() < 0.4:
                cue = pick(cues[kind])
                line.append((pick([cue, cue.title()]) + pick([" ", ": ", " no. ", " is ", " at "]), None))
            line += [(make[kind]() if kind else other(), kind), (pick([" ", " ", ", ", ". ", " or "]) + words() + " ", None)]
        lines.append(line)
    return lines


#: The columns of a labelled table: spans end before ``end``, in code points.
LABELLED = "line_id long, text string, spans array<struct<kind: string, start: int, end: int>>"
MOST_LINES = 2000


def labelled_table(spark: SparkSession) -> DataFrame:
    """``labelled_lines`` as a table. Lines of one's own in the same columns do as well."""
    rows = []
    for i, line in enumerate(labelled_lines()):
        text, spans = "", []
        for part, kind in line:
            if kind:
                spans.append((kind, len(text), len(text) + len(part)))
            text += part
        rows.append((i, text, spans))
    return spark.createDataFrame(rows, LABELLED)


def fit_field(labelled: DataFrame, most_lines: int = MOST_LINES) -> Crf:
    """The field fitted on a labelled table: its first ``most_lines`` lines by line_id; null texts and unknown kinds are left out."""
    rows = labelled.where("text is not null").select("line_id", "text", "spans").orderBy("line_id", "text").limit(most_lines).collect()
    return _fit([(r.text, [(s["kind"], s["start"], s["end"]) for s in r.spans or [] if s["kind"] in KINDS]) for r in rows])


def _fit(lines: list[tuple[str, list[tuple[str, int, int]]]]) -> Crf:
    feats, golds = [], []
    for text, spans in lines:
        toks = tokens(text)
        if not toks:
            continue
        gold = []
        for _, a, b in toks:
            kind = next(((k, s) for k, s, e in spans if s <= a and b <= e), None)
            gold.append(0 if kind is None else 1 + 2 * KINDS.index(kind[0]) + (a != kind[1]))
        feats.append(features(toks))
        golds.append(gold)
    return train(feats, golds, len(LABELS), steps=80)


def _stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around hints, REACH characters wide on each side; none spans a line end."""
    out: list[list[int]] = []
    hints = list(_hint.finditer(text))
    if "dot" in text or "Dot" in text or "DOT" in text:
        hints = sorted([*hints, *_dot.finditer(text)], key=lambda m: m.start())
    for m in hints:
        if out and m.start() < out[-1][1]:
            if m.end() + REACH > out[-1][1]:
                out[-1][1] = min(m.end() + REACH, out[-1][2])
            continue
        line_start = text.rfind("\n", max(0, m.start() - REACH), m.start()) + 1
        line_end = text.find("\n", m.end())
        line_end = len(text) if line_end < 0 else line_end
        lo = max(line_start, m.start() - REACH, out[-1][1] if out else 0, 0)
        out.append([lo, min(m.end() + REACH, line_end), line_end])
    return [(a, b) for a, b, _ in out]


def _parts(toks: list[tuple[str, int, int]]) -> Iterator[tuple[list[tuple[str, int, int]], int, int]]:
    """(tokens, first, stop) of overlapping parts; those from first to before stop are the part's own, each token in one part."""
    step, lo = LONGEST - OVERLAP, 0
    while True:
        part = toks[lo : lo + LONGEST]
        last = lo + LONGEST >= len(toks)
        yield part, OVERLAP // 2 if lo else 0, len(part) if last else LONGEST - OVERLAP // 2
        if last:
            return
        lo += step


def _trimmed(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The part of a span that has the form of its kind, if any."""
    found = text[a:b]
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "email":
        m = _written.search(found)
        return (a + m.start(), a + m.end()) if m else None
    if kind == "card":
        return (a, b) if 13 <= len(digits) <= 19 and luhn(digits) else None
    if kind == "phone":
        return (a, b) if 9 <= len(digits) <= 15 else None
    parts = re.findall("[0-9]+", found)
    return (a, b) if len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts) else None


class Finder:
    """Base spans and the field's own for batches of texts."""

    def __init__(self, crf: Crf):
        self.crf, self.cache = crf, {}
        self.max_features = 9

    def _rows(self, toks: list[tuple[str, int, int]]) -> np.ndarray:
        get = self.crf.index.get
        return np.array([[get(f, 0) for f in feats] for feats in features(toks)], np.int32)

    def more(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """For each text the spans that the field finds in it."""
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        jobs = []
        for i, text in enumerate(texts):
            for lo, hi in _stretches(text):
                # Whole words only: a stretch that begins or ends inside one grows to its edge.
                while lo > 0 and not text[lo - 1].isspace() and not text[lo].isspace() and lo > hi - 400:
                    lo -= 1
                while hi < len(text) and not text[hi - 1].isspace() and not text[hi].isspace() and hi < lo + 4000:
                    hi += 1
                toks = [(t, a + lo, b + lo) for t, a, b in tokens(text[lo:hi])]
                jobs += [(i, *part) for part in _parts(toks)]
        jobs.sort(key=lambda j: -len(j[1]))
        lo = 0
        while lo < len(jobs):
            part = jobs[lo : lo + max(1, 8 * LONGEST // len(jobs[lo][1]))]
            lo += len(part)
            lengths = np.array([len(t) for _, t, _, _ in part])
            padded = np.zeros((len(part), lengths.max(), self.max_features), np.int32)
            for k, (_, toks, _, _) in enumerate(part):
                padded[k, : len(toks)] = self._rows(toks)
            best = viterbi(self.crf, self.crf.scores(padded), lengths)
            for (i, toks, first, stop), labels in zip(part, best):
                found[i] += self._spans(texts[i], toks, labels, first, stop)
        return [sorted(set(x), key=lambda s: (KINDS.index(s[0]), s[1], s[2])) for x in found]

    @staticmethod
    def _spans(text: str, toks: list[tuple[str, int, int]], labels: np.ndarray, begin: int, stop: int) -> list[tuple[str, int, int]]:
        """The spans that begin with one of the tokens ``begin`` .. ``stop`` - 1."""
        out, k = [], 0
        while k < len(toks):
            if labels[k] <= 0:
                k += 1
                continue
            kind, first = (labels[k] - 1) // 2, k
            k += 1
            while k < len(toks) and labels[k] == 2 * kind + 2:
                k += 1
            a, b = toks[first][1], toks[k - 1][2]
            if not begin <= first < stop:
                continue
            if place := _trimmed(KINDS[kind], text, a, b):
                out.append((KINDS[kind], *place))
        return out

    def __call__(self, texts: list[str]) -> list[tuple[list, list]]:
        """(base spans, all spans) for each text, by kind as listed, then start."""
        out = []
        for text, extra in zip(texts, self.more(texts)):
            base = base_spans(text)
            taken: list[tuple[str, int, int]] = list(base)
            for s in extra:
                if all(s[2] <= a or b <= s[1] for _, a, b in taken):
                    taken.append(s)
            out.append((base, sorted(taken, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
        return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(model: Broadcast, batches: Iterator) -> Iterator:
    import pyarrow as pa

    finder = Finder(model.value)
    for rows in slices(batches):
        got = finder([t or "" for t in rows.column("text").to_pylist()])
        made = [rows.column("doc_id"), *(pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS)]
        made.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got]))
        made += [pa.array([joined(every) for _, every in got]), pa.array([len(every) for _, every in got], pa.int64())]
        yield pa.RecordBatch.from_arrays(made, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (added ones, too) for docs(doc_id, text)."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit_field(labelled_table(spark) if labelled is None else labelled))  # a few thousand weights
    return id_text(docs).mapInArrow(partial(_scan, model), schema)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return scan(read_table(spark, sf_dir, "documents"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first by start, then the longest."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]


def redaction_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, personal data in its text replaced; other columns stay as they are (n_chars follows the text)."""
    import pyarrow as pa

    names = [c if c in ("text", "n_chars") else f"c{i}" for i, c in enumerate(docs.columns)]
    plain = docs.toDF(*names)

    model = spark.sparkContext.broadcast(fit_field(labelled_table(spark)))

    def run(batches):
        finder = Finder(model.value)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            made = [None if t is None else redact(t, every) for t, (_, every) in zip(texts, finder([t or "" for t in texts]))]
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(made, batch.column("text").type)}
            if "n_chars" in columns:
                kind = batch.column("n_chars").type
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in made]).cast(kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
