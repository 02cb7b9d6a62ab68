"""Column expressions over multi-line text.

Everything here stays inside Catalyst: one text cell goes in, one value (often
an array with one entry per line) comes out, so no shuffle is ever needed to
get from a text to its lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineaudit.functions.binding import let

# Fixed values -----------------------------------------------------------
SIGNATURE_PREFIXES = ("fn ", "pub fn ", "spec fn ", "proof fn ", "exec fn ")
NEGATIVE_MARKERS = (
    "// FAILS", "// FIXME", "// TODO", "// BUG", "// XXX", "// HACK", "// broken", "// wrong",
)
POSITIVE_MARKERS = ("// ok", "// verified", "// passes")
SENTINEL = "<|fim_pad|>"
SUSPICIOUS_SUFFIX = "  // <-- SUSPICIOUS"
DSL_KEYWORDS = (
    "assert", "ensures", "invariant", "decreases", "requires",
    "forall", "exists", "assume", "recommends",
)
MARKER_KEYWORDS = (
    "panic!", "unwrap", "unsafe", "// FAILS", "// TODO", "// FIXME",
    "assert!", "todo!", "unimplemented!",
)
RUST_BLOCK = r"(?sU)```rust\s*\n(.*?)```"
ERROR_BLOCK = r"(?sU)The error messages are[^\n]*\n+\s*```(?:rust)?\s*\n(.*?)```"
CODE_FENCE = r"(?sU)```(?:rust|verus|rs)?\s*\n?(.*?)\n?```"
IMPORT_LINE = r"(?mU)^\s*use\s+vstd[^;]*;\s*$"
MACRO_WRAP = r"(?sU)verus!\s*\{\s*(.*?)\s*\}\s*(//[^\n]*)?\s*\z"
EMPTY_MAIN = r"(?mU)^\s*fn\s+main\s*\(\s*\)\s*\{\s*\}\s*$"
MAIN_SIGNATURE = r"(?U)^\s*(pub\s+)?fn\s+main\s*\("
BODY_OPENS = r"(?U)\{\s*$"
VERIFIER_RESULT = r"verification results::\s*(\d+)\s*verified,\s*(\d+)\s*errors"
VERIFIER_ERROR = r"(?m)^error:"
TEXT_MARKER = r"(?im)(?U)\s*//\s*(?:FAILS?|FIXME|TODO|BUG|XXX|HACK|broken|wrong|ok|verified|passes)\b.*?$"
LINE_MARKER = r"(?iU)\s*//\s*(FAILS|FIXME|fails[-_].*|expected[-_]fail.*)\b.*$"
# ------------------------------------------------------------------------

# Line ends and white space as Unicode knows them; Java's plain \s and Spark's
# trim() are both narrower.
_EOL = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
_WS = r"[\s\x1C-\x1F]"


def splitlines(text: Column) -> Column:
    """Lines of a text, without the empty piece after a final line end."""
    return let(F.split(text, _EOL), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def strip(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?U)^{_WS}+|{_WS}+\z", "")


def lstrip(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?U)^{_WS}+", "")


def rstrip(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?U){_WS}+\z", "")


def is_blank(s: Column) -> Column:
    return s.rlike(rf"(?U)^{_WS}*\z")


def is_scorable(line: Column) -> Column:
    """Neither blank nor a pure comment; lone braces do count."""
    return ~line.rlike(rf"(?U)^{_WS}*(\z|//|/\*|\*/|\*)")


def is_scorable_strict(line: Column) -> Column:
    """The narrower policy of the repair experiment: brace-only lines are out too."""
    s = strip(line)
    return ~(
        (s == "")
        | s.isin("{", "}", "{}", "()", ");")
        | s.startswith(")")
        | (s.startswith("//") & ~s.contains("// FAILS"))
    )


def indices_where(lines: Column, predicate) -> Column:
    """0-based positions of the lines for which ``predicate(line)`` holds."""
    hits = F.transform(lines, lambda x, i: F.when(predicate(x), i))
    return F.filter(hits, lambda i: i.isNotNull())


def scorable_line_indices(lines: Column) -> Column:
    return indices_where(lines, is_scorable)


def scorable_texts(lines: Column) -> Column:
    return F.filter(lines, is_scorable)


def to_sentinel_space(source_indices: Column, scorable_indices: Column) -> Column:
    """Source-line labels to positions among the scorable lines, sorted, distinct."""
    pos = let(scorable_indices, lambda sc: F.transform(
        source_indices, lambda x: F.array_position(sc, x).cast("int") - 1))
    return F.array_sort(F.array_distinct(F.filter(pos, lambda p: p >= 0)))


def insert_sentinels(lines: Column, sentinel: str = SENTINEL) -> Column:
    """A sentinel line after every scorable line."""
    out = F.flatten(F.transform(
        lines, lambda x: F.when(is_scorable(x), F.array(x, F.lit(sentinel))).otherwise(F.array(x))))
    return join_lines(out)


def join_spec_impl(spec: Column, impl: Column) -> Column:
    return F.concat(rstrip(spec), F.lit("\n"), F.regexp_replace(impl, r"^\n+", ""))


def squeeze_hash(text: Column, length: int | None = None) -> Column:
    """SHA-1 of the text with all white space removed, optionally cut short."""
    h = F.sha1(F.encode(F.regexp_replace(text, rf"(?U){_WS}+", ""), "UTF-8"))
    return h if length is None else F.substring(h, 1, length)


def text_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, length)


def normalize_line(line: Column) -> Column:
    """Strip, then cut a trailing comment."""
    return strip(F.substring_index(line, "//", 1))


# -- markers ---------------------------------------------------------------

def strip_fails(lines: Column) -> Column:
    """Cut every line at ``// FAILS``; untouched lines keep their white space."""
    return F.transform(lines, lambda x: F.when(
        x.contains("// FAILS"), rstrip(F.substring_index(x, "// FAILS", 1))).otherwise(x))


def strip_markers(text: Column) -> Column:
    """Remove marker comments from a whole text.

    White space before the marker goes too, line ends included, so lines may
    be joined and line numbers may shift.
    """
    return F.regexp_replace(text, TEXT_MARKER, "")


def strip_line_markers(lines: Column) -> Column:
    """Per-line removal of FAILS, FIXME, fails-… and expected-fail… comments."""
    return F.transform(lines, lambda x: F.regexp_replace(x, LINE_MARKER, ""))


def fails_line_indices(lines: Column) -> Column:
    return indices_where(lines, lambda x: x.contains("// FAILS"))


def inject_marker(line: Column, marker: Column) -> Column:
    base = rstrip(line)
    return F.concat(base, F.when(base.contains("//"), F.lit(" ")).otherwise(F.lit("  ")), marker)


def flag_suspicious(lines: Column, scorable_indices: Column, top: Column, k: int = 3) -> Column:
    """Append the suspicion suffix to the source lines of the first k ranked positions."""
    picked = let(scorable_indices, lambda sc: F.transform(
        F.slice(top, 1, k), lambda p: F.when(p >= 0, F.get(sc, p))))
    picked = F.filter(picked, lambda p: p.isNotNull())
    return join_lines(let(picked, lambda hot: F.transform(lines, lambda x, i: F.when(
        F.array_contains(hot, i), F.concat(x, F.lit(SUSPICIOUS_SUFFIX))).otherwise(x))))


def numbered_lines(lines: Column) -> Column:
    return join_lines(F.transform(lines, lambda x, i: F.concat(i.cast("string"), F.lit(": "), x)))


# -- spec / impl -------------------------------------------------------------

def _first(lines: Column, predicate) -> Column:
    """1-based position of the first line satisfying the predicate, 0 if none."""
    return F.array_position(F.transform(lines, predicate), F.lit(True)).cast("int")


def signature_line(lines: Column, skip_main: bool = True) -> Column:
    """0-based index of the first function signature, NULL if there is none."""
    alt = "|".join(SIGNATURE_PREFIXES)

    def pred(x):
        hit = x.rlike(rf"(?U)^{_WS}*({alt})")
        return hit & ~x.rlike(MAIN_SIGNATURE) if skip_main else hit

    return F.nullif(_first(lines, pred), F.lit(0)) - 1


def spec_impl_bounds(lines: Column) -> Column:
    """struct(spec_from, spec_to): the 1-based closed line range of the spec.

    With a signature the range runs from it to the line that opens the body
    (to the end when none does); without one it ends at the first line holding
    a brace. NULL when neither exists.
    """
    sig = signature_line(lines) + 1
    opening = let(sig, lambda first: F.array_position(F.transform(
        lines, lambda x, i: x.rlike(BODY_OPENS) & (i + 1 >= first)), F.lit(True)).cast("int"))
    brace = _first(lines, lambda x: x.contains("{"))
    return (
        F.when(sig.isNotNull(), F.struct(
            sig.alias("spec_from"),
            F.coalesce(F.nullif(opening, F.lit(0)), F.size(lines)).alias("spec_to")))
        .when(brace > 0, F.struct(F.lit(1).alias("spec_from"), brace.alias("spec_to")))
    )


def spec_impl(text: Column) -> Column:
    """struct(spec, impl) of a source text, each input evaluated once."""
    def parts(t, lines, b):
        lo, hi = b["spec_from"], b["spec_to"]
        return F.struct(
            F.when(b.isNull(), t).otherwise(join_lines(F.slice(lines, lo, hi - lo + 1))).alias("spec"),
            F.when(b.isNull(), F.lit("")).otherwise(join_lines(F.slice(lines, hi + 1, F.size(lines)))).alias("impl"))

    return let(text, lambda t: let(splitlines(t), lambda ls: let(spec_impl_bounds(ls), lambda b: parts(t, ls, b))))


def heuristic_spec_impl(body: Column) -> Column:
    """struct(spec, impl) cut before the first ``fn … {`` line; both are the body if there is none."""
    def parts(t, lines, at):
        return F.struct(
            F.when(at == 0, t).otherwise(join_lines(F.slice(lines, 1, F.greatest(at - 1, F.lit(0))))).alias("spec"),
            F.when(at == 0, t).otherwise(join_lines(F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines)))).alias("impl"))

    return let(body, lambda t: let(splitlines(t), lambda ls: let(first_exec_fn(ls), lambda at: parts(t, ls, at))))


def first_exec_fn(lines: Column) -> Column:
    """1-based line of the first ``fn … {`` line, 0 if none (scraper's split rule)."""
    return _first(lines, lambda x: strip(x).startswith("fn ") & x.contains("{"))


# -- fenced blocks and verifier output -------------------------------------------

def _block(text: Column, pattern: str, trim) -> Column:
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda found: trim(F.get(found, 0)))


def rust_block(text: Column) -> Column:
    """First ```rust fenced block, right-stripped; NULL if there is none."""
    return _block(text, RUST_BLOCK, rstrip)


def error_block(text: Column) -> Column:
    return _block(text, ERROR_BLOCK, strip)


def nonempty(s: Column) -> Column:
    return let(s, lambda v: F.when(v != "", v))


def response_code(content: Column) -> Column:
    """Code of a model answer with imports, wrapper macro and empty main removed."""
    code = let(strip(content), lambda t: F.coalesce(
        _block(t, CODE_FENCE, strip), F.when(~t.startswith("```"), t)))
    code = F.regexp_replace(code, IMPORT_LINE, "")
    code = let(code, lambda t: F.coalesce(_block(t, MACRO_WRAP, strip), t))
    code = F.regexp_replace(code, EMPTY_MAIN, "")
    return nonempty(strip(code))


def verifier_counts(output: Column) -> Column:
    """struct(n_verified, n_errors) read from a verifier's combined output."""
    pat = VERIFIER_RESULT
    seen = output.rlike(pat)
    return F.struct(
        F.when(seen, F.regexp_extract(output, pat, 1).cast("int")).otherwise(F.lit(0)).alias("n_verified"),
        F.when(seen, F.regexp_extract(output, pat, 2).cast("int")).otherwise(
            F.size(F.regexp_extract_all(output, F.lit(VERIFIER_ERROR), 0))).alias("n_errors"),
    )


def file_safe(name: Column) -> Column:
    return F.regexp_replace(name, r"[/\\]", "__")


# -- similarity ------------------------------------------------------------------

def bigrams(s: Column) -> Column:
    """Set of character bigrams; a one-character string is its own token."""
    def pairs(chars):
        return F.when(F.size(chars) < 2, chars).otherwise(F.array_distinct(F.transform(
            F.slice(chars, 2, F.size(chars)), lambda c, i: F.concat(F.get(chars, i), c))))

    return let(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), pairs)


def bigram_codes(s: Column) -> Column:
    """The same set as numbers: both code points packed into one long."""
    def pairs(codes):
        return F.when(F.size(codes) < 2, codes).otherwise(F.array_distinct(F.transform(
            F.slice(codes, 2, F.size(codes)), lambda c, i: F.get(codes, i) * F.lit(1 << 21).cast("long") + c)))

    chars = F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    return let(F.transform(chars, lambda c: F.ascii(c).cast("long")), pairs)


def char_jaccard(a: Column, b: Column) -> Column:
    ga, gb = bigrams(a), bigrams(b)
    return (
        F.when((F.size(ga) == 0) & (F.size(gb) == 0), F.lit(1.0))
        .when((F.size(ga) == 0) | (F.size(gb) == 0), F.lit(0.0))
        .otherwise(F.size(F.array_intersect(ga, gb)) / F.size(F.array_union(ga, gb)))
    )
