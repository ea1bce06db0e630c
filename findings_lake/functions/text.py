"""Text and JSON helpers with Python semantics, as Catalyst expressions.

Java and Python regexes differ in three ways that matter here: ``\\s`` (Java
ASCII by default, Python Unicode ``str.isspace``), ``$`` (Java also matches
before ``\\r``/``\\u2028``, Python only before ``\\n``) and the end anchor of a
non-multiline ``$`` (Java allows a final line terminator). We spell the
whitespace class out, use ``(?md)`` for multi-line patterns and ``\\z`` for
true end of input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() / re ``\s`` accept,
# as a literal set and as a Java regex class.
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")
PY_WS = ("[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\xA0\\x{1680}\\x{2000}-\\x{200A}"
         "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")

# Markdown fence patterns (both multi-line) and the greedy
# array fallback of the reply parser.
FENCE_OPEN = "(?md)^```(?:json)?" + PY_WS + "*"
FENCE_CLOSE = "(?md)" + PY_WS + "*```$"
ARRAY_FALLBACK = "(?s)\\[.*\\]"

TRIPLE_QUOTE = '"""'


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: Python whitespace at both ends (a character-set
    trim, no regex scan)."""
    return F.trim(_col(c), F.lit(PY_WS_CHARS))


def strip_fences(c) -> Column:
    """Strip, drop opening/closing markdown fences on any line, strip.

    Both fence patterns need a backtick run, so texts without one skip the
    regex passes.
    """
    t = py_strip(c)
    fenced = F.regexp_replace(F.regexp_replace(t, FENCE_OPEN, ""), FENCE_CLOSE, "")
    return py_strip(F.when(t.contains("```"), fenced).otherwise(t))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


# A double quote that is not escaped: an even number of backslashes stands
# before it (counted up to 100).
UNESCAPED_QUOTE = '(?<=(?<!\\\\)(?:\\\\\\\\){0,50})"'
#: Stands before a number word where it is kept as a JSON text (private use).
WORD_MARK = "\ue000"
# The number words of Python's JSON reader.
NUMBER_WORDS = "(?<![\\w.+-])(NaN|-?Infinity)(?![\\w.+-])(?!\\s*:)"


def outside_strings(t: Column, body, inside=None) -> Column:
    """``t`` (JSON text) with ``body`` applied to what lies between its
    strings and ``inside`` (the contents without quotes -> whole token) to the
    strings: pieces of a split on unescaped quotes alternate, outside first."""
    kept = inside or (lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return F.array_join(F.transform(F.split(t, UNESCAPED_QUOTE, -1),
                                    lambda x, i: F.when(i % 2 == 0, body(x)).otherwise(kept(x))), "")


def number_words(t: Column) -> Column:
    """``NaN``, ``Infinity`` and ``-Infinity`` outside strings as marked JSON
    texts, which ``py_str`` and ``py_float`` read back as the numbers they
    are; texts without such a word pass as they are."""
    marked = outside_strings(t, lambda x: F.regexp_replace(x, NUMBER_WORDS, f'"{WORD_MARK}$1"'))
    return F.when(t.contains("NaN") | t.contains("Infinity"), marked).otherwise(t)


def one_json_value(t: Column) -> Column:
    """The variant of ``t`` if it is exactly one JSON value, by one parse.

    The parser stops after the first value, so ``t`` is read as the first
    element of an array that ends with a mark made of ``t``'s own hash: text
    behind the value leaves no such array of two.
    """
    mark = F.xxhash64(t).cast("string")
    wrapped = F.try_parse_json(F.concat(F.lit("["), t, F.lit(',"'), mark, F.lit('"]'))).try_cast("array<variant>")
    return let(wrapped, lambda p: F.when(
        (F.size(p) == 2) & (F.try_variant_get(F.get(p, 1), "$", "string") == mark), F.get(p, 0)))


def one_typed_object(t: Column, fields: str) -> Column:
    """``t`` read as a struct of ``fields`` if it is exactly one JSON object
    (else null), by one typed parse without a size cap: the same end mark as
    in ``one_json_value``, here as a second object."""
    mark = F.xxhash64(t).cast("string")
    wrapped = F.from_json(F.concat(F.lit("["), t, F.lit(',{"end mark":"'), mark, F.lit('"}]')),
                          f"array<struct<{fields},`end mark`:string>>")
    only = let(wrapped, lambda p: F.when((F.size(p) == 2) & (F.get(p, 1)["end mark"] == mark), F.get(p, 0)))
    return F.when(F.ltrim(t).startswith("{"), only)


def json_kind(v: Column) -> Column:
    """Top-level kind of a variant: ARRAY, OBJECT, STRING, VOID, BIGINT, ..."""
    s = F.schema_of_variant(v)
    return F.substring_index(F.substring_index(s, "<", 1), "(", 1)


def parse_json_array(c) -> Column:
    """The text as ``array<variant>`` if it is exactly one JSON list."""
    return one_json_value(_col(c)).try_cast("array<variant>")


def parse_json_object(c) -> Column:
    """The text as a variant if it is exactly one JSON object."""
    return let(one_json_value(_col(c)), lambda v: F.when(is_object(v), v))


def is_object(v: Column) -> Column:
    return v.try_cast("map<string,variant>").isNotNull()


def fallback_array_text(c) -> Column:
    """Greedy first ``[`` to last ``]`` (dot matches newline)."""
    return F.regexp_extract(_col(c), ARRAY_FALLBACK, 0)


# The escapes and their order.
def json_escape_inner(x: Column) -> Column:
    """Escape order used for triple-quoted blocks: \\ " LF CR TAB."""
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(x, F.lit('"'), F.lit('\\"'))
    x = F.replace(x, F.lit("\n"), F.lit("\\n"))
    x = F.replace(x, F.lit("\r"), F.lit("\\r"))
    return F.replace(x, F.lit("\t"), F.lit("\\t"))


def repair_triple_quotes(c) -> Column:
    """Every closed ``\"\"\"...\"\"\"`` block becomes an escaped JSON string.

    Splitting on the delimiter pairs blocks exactly as a left-to-right lazy
    match does: odd parts are block bodies, except a last odd part after an
    unmatched delimiter, which keeps its quotes.
    """
    def fixed(parts):
        last = F.size(parts) - 1
        return F.array_join(F.transform(
            parts,
            lambda x, i: F.when((i % 2 == 1) & (i < last),
                                F.concat(F.lit('"'), json_escape_inner(x), F.lit('"')))
            .when(i % 2 == 1, F.concat(F.lit(TRIPLE_QUOTE), x))
            .otherwise(x)), "")

    return let(_col(c), lambda t: F.when(t.contains(TRIPLE_QUOTE), let(F.split(t, TRIPLE_QUOTE, -1), fixed)).otherwise(t))


def path_name(c) -> Column:
    """Last path component."""
    return F.element_at(F.split(_col(c), "/", -1), -1)


def path_stem(c) -> Column:
    """``Path(p).stem``: file name without its last suffix (a leading dot is
    not a suffix)."""
    return F.regexp_replace(path_name(c), "(?<=[\\s\\S])\\.[^.]+\\z", "")


def py_number(kind: Column, s: Column) -> Column:
    """Python's text of a JSON number, from its kind and Java's text: a
    literal with a point or an exponent is a float and keeps ``.0``; exponents
    read ``1e-07``. (A whole number beyond 64 bits reads as an integer.)"""
    whole = (kind == "DECIMAL") & ~s.contains(".") & (F.length(s) < 19)
    mantissa = F.regexp_replace(F.regexp_extract(s, "^(-?[0-9.]+)E", 1), "[.]0$", "")
    power = F.regexp_extract(s, "E(-?[0-9]+)$", 1).try_cast("int")
    plain = F.regexp_replace(F.regexp_replace(
        s.try_cast("double").try_cast("decimal(38,18)").cast("string"), "0+$", ""), "[.]$", ".0")
    exponent = F.concat(mantissa, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
                        F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    return (F.when(whole, F.concat(s, F.lit(".0")))
            .when(s.contains("Infinity"), F.replace(s, F.lit("Infinity"), F.lit("inf")))
            .when(s.contains("E") & power.between(-4, 15), plain)
            .when(s.contains("E"), exponent)
            .otherwise(s))


# Characters Python's repr() escapes besides the named ones: everything in the
# categories "other" and "separator" but the plain space.
NOT_PRINTABLE = "[\\p{C}\\p{Z}&&[^ ]]"


def _escaped_char(c: Column) -> Column:
    code = F.ascii(c)
    digits = F.lower(F.hex(code))
    width = F.when(code < 256, 2).when(code < 65536, 4).otherwise(8)
    lead = F.when(code < 256, F.lit("\\x")).when(code < 65536, F.lit("\\u")).otherwise(F.lit("\\U"))
    return F.when(c.rlike(NOT_PRINTABLE), F.concat(lead, F.lpad(digits, width, F.lit("0")))).otherwise(c)


def py_quoted(s: Column) -> Column:
    """``repr()`` of a text: single quotes unless only single ones occur in it."""
    double = s.contains("'") & ~s.contains('"')
    body = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    body = F.when(double, body).otherwise(F.replace(body, F.lit("'"), F.lit("\\'")))
    for char, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(name))
    body = F.when(body.rlike(NOT_PRINTABLE), F.array_join(F.transform(F.split(body, ""), _escaped_char), "")).otherwise(body)
    mark = F.when(double, F.lit('"')).otherwise(F.lit("'"))
    return F.concat(mark, body, mark)


def py_repr(json_text: Column) -> Column:
    """``str()`` of a nested JSON value as Python's reader gives it: ``True``,
    ``None``, its quotes, a space behind commas and colons, its numbers."""
    def plain(x):
        numbers = F.array_join(F.transform(F.regexp_extract_all(x, F.lit("[-+0-9.E]+|[^-+0-9.E]+"), F.lit(0)), lambda n: F.when(
            n.rlike("^-?[0-9.]+E"), py_number(F.lit("DOUBLE"), n)).otherwise(n)), "")
        x = F.when(x.contains("E"), numbers).otherwise(x)
        for word, shown in (("true", "True"), ("false", "False"), ("null", "None"), (",", ", "), (":", ": ")):
            x = F.replace(x, F.lit(word), F.lit(shown))
        return x

    def quoted(x):
        content = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), x, F.lit('"'))), "$", "string")
        return let(content, lambda s: F.when(s.startswith(WORD_MARK), special_text(s)).otherwise(py_quoted(s)))

    return outside_strings(json_text, plain, quoted)


def special_text(s: Column) -> Column:
    """Python's text of a marked number word."""
    word = F.substring(s, 2, 9)
    return F.when(word == "NaN", F.lit("nan")).when(word == "Infinity", F.lit("inf")).otherwise(F.lit("-inf"))


# Numbers as Python's float() reads them from a text (a Java suffix as in "0.5d" is none).
NUMBER_TEXT = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE_TEXT = "^(?i)[+-]?(inf|infinity|nan)$"


def py_float(v: Column) -> Column:
    """``float(v)`` of a variant; null where Python raises an error."""
    s = py_strip(F.try_variant_get(v, "$", "string"))
    word = F.lower(F.regexp_replace(s, f"^{WORD_MARK}", ""))
    special = (F.when(word.endswith("nan"), F.lit(float("nan"))).when(word.startswith("-"), F.lit(float("-inf")))
               .otherwise(F.lit(float("inf"))))
    number = F.try_variant_get(v, "$", "double")
    return F.when(json_kind(v) != "STRING", number).when(word.rlike(INFINITE_TEXT), special).when(s.rlike(NUMBER_TEXT), number)


def py_str(v: Column, default: Column | str | None, nested: Column | None = None) -> Column:
    """``str(d.get(key, default))`` for a variant field ``v``.

    Absent -> default; JSON null -> ``None``; booleans -> ``True``/``False``;
    strings as they are; numbers as Python prints them; lists and objects as
    Python prints them, from ``nested``, their JSON text in the order of the
    reply (a variant sorts its keys; without ``nested`` they come sorted).
    """
    text_of = F.to_json(v) if nested is None else F.coalesce(nested, F.to_json(v))
    return let(F.struct(json_kind(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("s")), lambda x: (
        F.when(x["kind"].isNull(), default if isinstance(default, Column) else F.lit(default))
        .when(x["kind"] == "STRING", F.when(x["s"].startswith(WORD_MARK), special_text(x["s"])).otherwise(x["s"]))
        .when(x["kind"] == "VOID", F.lit("None"))
        .when(x["kind"] == "BOOLEAN", F.when(x["s"] == "true", F.lit("True")).otherwise(F.lit("False")))
        .when(x["kind"].isin("OBJECT", "ARRAY"), py_repr(text_of))
        .when(x["kind"].isin("DECIMAL", "DOUBLE", "FLOAT"), py_number(x["kind"], x["s"]))
        .otherwise(x["s"])))


def first_lines(c, n: int) -> Column:
    """The first ``n`` lines of a text (``splitlines()[:n]`` on ``\\n``)."""
    return F.slice(F.split(_col(c), "\n", -1), 1, n)
