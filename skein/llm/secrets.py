"""Secret scans in DataFrame expressions only.

Base kinds (assign, access, hex) are patterns. The kind ``entropy`` adds strings that look random:
candidates are runs of at least ``WINDOW`` token characters with letters and digits, or with letters whose case
switches as in no word; a window of ``WINDOW`` characters slides over each, and its Shannon entropy follows from
incremental counts: with f(n) = n log2 n, the sum S of f over the window's character counts changes by
f(n+1) - f(n) for the character that enters and f(n-1) - f(n) for the one that leaves, where the counts
are read off the window itself. Entropy = log2 W - S / W. A candidate is a secret if its largest window
entropy reaches the threshold of its character class and the allow-list does not suppress it.

A match's place is found without any per-row code: every match is put between two marks (characters
that Unicode keeps unassigned; such characters in a text are first changed to a third one), the text is
split at the marks, and lengths are summed. Positions are code points, ends exclusive.

Cases: null texts count as empty and give the hash of an empty string; repeated rows each get their
row; candidates that touch a base span are left to it. The work grows with a candidate's length, and no pattern
recurses on it: a candidate of a million characters is one like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_text, read_table

WINDOW = 20
OPEN, CLOSE, OTHER = "﷐", "﷑", "﷒"

ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

# Least window entropy, in bits, by character class: hexadecimal digits, one case of letters with digits, both cases with
# digits, letters of both cases alone.
THRESHOLDS = {"hex": 3.0, "alnum": 3.4, "base64": 3.8, "letters": 3.9}
# The allow-list. Whole strings: universally unique ids, and words or numbers joined by the JOINTS. Stretches: placeholders.
ALLOWED = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
JOINTS = r"[-_/=]"
PLACEHOLDER = r"(?i)example|placeholder|changeme|xxxx|0123456789|abcdefgh|wJalrXUtnFEMI/K7MDENG"
# Letters alone look random only if their case switches as in no word: three times one to three capitals and one or two small
# letters, then a capital.
SWITCHES = r"(?:[A-Z]{1,3}[a-z]{1,2}){3}[A-Z]"


def _pieces(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Array of struct(s, e, m): start, end and text of each leftmost non-overlapping match that ``keep`` keeps."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]")
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")

    def step(a: Column, m: Column) -> Column:
        # Every second part is a match. The array grows only by what is kept, so most steps copy nothing.
        end = a["at"] + F.length(m)
        wanted = a["match"] if keep is None else a["match"] & keep(m)
        more = F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), end.alias("e"), m.alias("m"))))
        return F.struct(end.alias("at"), (~a["match"]).alias("match"), F.when(wanted, more).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), none.alias("out"))
    return F.when(F.size(parts) > 1, F.aggregate(parts, start, step, lambda a: a["out"])).otherwise(none)


def _f(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def _count(where: Column, what: Column) -> Column:
    return (F.length(where) - F.length(F.replace(where, what, F.lit("")))).cast("double")


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy of a window of ``s``, by incremental counts; null if ``s`` is shorter.

    The string is cut into its characters once, and each step sees one window only: the work grows with the length.
    """
    first = F.substring(s, F.lit(1), F.lit(window))
    chars = F.array_distinct(F.split(first, ""))
    start = F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(_f(_count(first, c))))

    def step(a: Column, enters: Column) -> Column:
        # The window's first character leaves, ``enters`` comes in at its end.
        leaves, kept = F.substring(a["window"], F.lit(1), F.lit(1)), F.substring(a["window"], F.lit(2), F.lit(window - 1))
        out, into = _count(a["window"], leaves), _count(kept, enters)
        now = a["sum"] - _f(out) + _f(out - 1) - _f(into) + _f(into + 1)
        return F.struct(now.alias("sum"), F.least(a["least"], now).alias("least"), F.concat(kept, enters).alias("window"))

    later = F.filter(F.split(F.substring(s, F.lit(window + 1), F.length(s)), ""), lambda c: c != "")
    begin = F.struct(start.alias("sum"), start.alias("least"), first.alias("window"))
    least = F.aggregate(later, begin, step, lambda a: a["least"])
    return F.when(F.length(s) >= window, F.log2(F.lit(float(window))) - least / window)


def looks_random(s: Column) -> Column:
    """Whether some stretch of a candidate without placeholders reaches its class threshold and the allow-list lets it pass.

    A placeholder hides itself only: what stands before and after it is judged on its own.
    """

    def random(part: Column) -> Column:
        letters, digits = part.rlike("[A-Za-z]"), part.rlike("[0-9]")
        mixed = part.rlike("[a-z]") & part.rlike("[A-Z]")
        least = (
            F.when(digits & part.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"])
            .when(digits & mixed, THRESHOLDS["base64"])
            .when(digits, THRESHOLDS["alnum"])
            .otherwise(THRESHOLDS["letters"])
        )
        # Every word (see ALLOWED) is letters or digits only; one without digits may also be random letters of both cases.
        words = F.forall(F.split(part, JOINTS), lambda w: w.rlike("^(?:[A-Za-z]*|[0-9]*)$"))
        single = part.rlike("^[A-Za-z]+$") & mixed & part.rlike(SWITCHES)
        fit = (F.length(part) >= WINDOW) & letters & ((digits & ~words) | single) & ~part.rlike(ALLOWED)
        # Conditions are tried in order: windows slide only over parts that may count.
        return F.when(fit, window_entropy(part) >= least).otherwise(F.lit(False))

    return F.exists(F.split(s, PLACEHOLDER), random)


def _key(kind: str, order: int, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")).alias("t")))


def _joined(spans: Column) -> Column:
    """Spans by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: x["t"]), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for docs(doc_id, text)."""
    text = F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, OTHER + OTHER)
    rows = id_text(docs).select("doc_id", text.alias("text"))
    rows = rows.select(
        "doc_id",
        _pieces(F.col("text"), ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8).alias("assign"),
        _pieces(F.col("text"), ACCESS).alias("access"),
        _pieces(F.col("text"), HEX).alias("hex"),
        _pieces(F.col("text"), CANDIDATE, looks_random).alias("found"),
    )
    base = F.concat(_key("assign", 0, F.col("assign")), _key("access", 1, F.col("access")), _key("hex", 2, F.col("hex")))
    rows = rows.withColumn("base", base)
    apart = F.filter("found", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    rows = rows.withColumn("more", _key("entropy", 3, apart))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "more")).alias("spans"),
        F.size("more").cast("long").alias("n_entropy"),
    )


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return scan(read_table(spark, sf_dir, "documents"))
