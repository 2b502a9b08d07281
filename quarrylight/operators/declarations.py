"""Types and methods of Java, Kotlin and Smali sources as chunks; what they leave is cut into pieces.

A brace language needs its heads read word by word and its braces matched, which no built-in function does: a small scanner
does that in Arrow batches and gives line ranges only. Gaps, contents and Smali are DataFrame operations.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarrylight.functions.text import lines
from quarrylight.operators.chunking import gaps, line_windows, ordinal_ranges, ordinals
from quarrylight.session import for_workers

RANGE = "path string, kind string, symbol string, start_line int, end_line int"
_BLANK = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"{3}.*?(?:"{3}|\Z)|(["'])(?:\\.|(?!\1)[^\\])*(?:\1|\\?\Z)""", re.S)
# The words that a head is made of.
TYPE_KINDS = frozenset(("class", "interface", "enum", "record", "object"))
TYPE_MODIFIERS = frozenset((
    "public", "protected", "private", "internal", "abstract", "final", "sealed", "open", "data", "value", "annotation", "enum",
    "static", "strictfp", "fun",
))
JAVA_MODIFIERS = frozenset((
    "public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "strictfp", "default", "transient",
))
KOTLIN_MODIFIERS = frozenset((
    "public", "protected", "private", "internal", "final", "open", "abstract", "override", "suspend", "inline", "tailrec",
    "operator", "infix", "external",
))
VISIBILITY = frozenset(("public", "protected", "private", "internal"))
# Words before a parenthesis that name no Java method.
NO_METHOD = frozenset(("catch", "do", "else", "for", "if", "new", "return", "switch", "synchronized", "try", "while"))

_WORD = re.compile(r"[\w$]+")
_SPACE = re.compile(r"\s*")
_INDENT = re.compile(r"[ \t]*")
_MARK = re.compile(r"@[A-Za-z_$][\w$.]*(?:\([^()\n]*\))?[ \t]*\n?[ \t]*")
_RECEIVER = re.compile(r"[A-Za-z_$][\w$<>?.]*")
_LETTER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")
# What ends a search from a head: the places of each kind are listed once and then looked up by bisection.
_PLACES = {"body": "[{;]", "region": "[{};]", "bound": "[{=;]", "angle": "[>{};]", "line": r"[\n{=;]", "close": r"\)"}


def mask(text: str) -> str:
    """Comments and literals become spaces; offsets and line feeds stay. A literal ends at its quote, on whatever line."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


class _Source:
    """Masked code with the places that end a search. Runs of annotations and modifiers are read once for all lines they reach over."""

    def __init__(self, code: str):
        self.code = code
        self.places = {k: [m.start() for m in re.finditer(v, code)] for k, v in _PLACES.items()}
        closes = self.places["close"]
        self.places["value"] = [p for p in closes if self.char(self.after("line", p)) == "="]
        self.places["body_close"] = [p for p in closes if self.char(self.space(p + 1)) == "{"]
        self.places["throws"] = [p for p in closes if self._throws(self.space(p + 1))]
        self.marked: dict[int, int] = {}
        self.skipped: dict[frozenset, dict[int, int]] = {}
        self.named: dict[int, tuple[str, int] | None] = {}

    def char(self, at: int) -> str:
        return self.code[at : at + 1]

    def space(self, at: int) -> int:
        return _SPACE.match(self.code, at).end()

    def after(self, kind: str, at: int) -> int:
        places = self.places[kind]
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else len(self.code)

    def before(self, kind: str, at: int) -> int:
        i = bisect.bisect_left(self.places[kind], at)
        return self.places[kind][i - 1] if i else -1

    def word(self, at: int) -> str:
        return m[0] if (m := _WORD.match(self.code, at)) else ""

    def name(self, at: int) -> str:
        return self.word(at) if self.char(at) in _LETTER else ""

    def _throws(self, at: int) -> bool:
        return self.word(at) == "throws" and self.space(at + 6) > at + 6

    def marks(self, at: int) -> int:
        """Behind the annotations from here: arguments without parentheses, one line feed at most between two."""
        seen = []
        while at not in self.marked and (m := _MARK.match(self.code, at)):
            seen.append(at)
            at = m.end()
        at = self.marked.get(at, at)
        self.marked |= dict.fromkeys(seen, at)
        return at

    def skip(self, at: int, words: frozenset) -> int:
        known, seen = self.skipped.setdefault(words, {}), []
        while at not in known and (w := self.word(at)) in words and (behind := self.space(at + len(w))) > at + len(w):
            seen.append(at)
            at = behind
        at = known.get(at, at)
        known |= dict.fromkeys(seen, at)
        return at

    def type_name(self, at: int) -> tuple[str, int] | None:
        """The last word behind a kind, and its end, in the run of modifiers from here and the words that end it."""
        seen, before, found = [], None, None
        while w := self.word(at):
            end = at + len(w)
            if before is not None:
                if at in self.named:
                    found = self.named[at]
                    break
                seen.append((at, (w, end) if before in TYPE_KINDS and w[0] in _LETTER else None))
            behind = self.space(end)
            if (before is not None and before not in TYPE_MODIFIERS) or behind == end:
                break
            before, at = w, behind
        for place, here in reversed(seen):
            found = self.named[place] = found or here
        return found

    def generic(self, at: int) -> int:
        """Behind the type arguments that begin here, up to the first closing bracket, or here."""
        end = self.after("angle", at + 1) if self.char(at) == "<" else 0
        return end + 1 if end > at + 1 and self.char(end) == ">" else at


# A head's parser gets a line's first word and gives (symbol's last name, brace or None, where the next head may begin, has a type).
Head = tuple[str, int | None, int, bool]


def _type(s: _Source, at: int) -> Head | None:
    """Modifiers, the kind, a name; then whatever is no semicolon up to the brace."""
    found = s.type_name(at)
    if not found:
        return None
    brace = s.after("body", found[1])
    return (found[0], brace, brace + 1, True) if s.char(brace) == "{" else None


def _parameters(s: _Source, at: int) -> int | None:
    """The brace behind parameters that open here, with nothing or a throws clause between."""
    stop = s.after("region", at + 1)
    if s.before("body_close", stop) > at:
        return stop
    if (close := s.before("throws", stop)) > at and s.char(brace := s.after("body", close)) == "{":
        return brace
    return None


def _java_method(s: _Source, at: int) -> Head | None:
    """Annotations, modifiers, type parameters, perhaps a type, a name and parameters. Type arguments end at their first bracket."""
    at = s.skip(s.marks(at), JAVA_MODIFIERS)
    if (behind := s.generic(at)) > at:
        at = s.space(behind)
    name = s.name(at)
    if not name:
        return None
    end, typed = at + len(name), False
    far = end  # behind a type: dotted names, arguments, one pair of brackets
    while s.char(far) == "." and (part := s.name(far + 1)):
        far += 1 + len(part)
    far = s.generic(x) if s.generic(x := s.space(far)) > x else far
    if s.char(x := s.space(far)) == "[" and s.char(y := s.space(x + 1)) == "]":
        far = y + 1
    start = s.space(far)
    if start > far and (second := s.name(start)) and s.char(s.space(start + len(second))) == "(":
        name, end, typed = second, start + len(second), True
    paren = s.space(end)
    brace = _parameters(s, paren) if s.char(paren) == "(" else None
    return None if brace is None else (name, brace, brace + 1, typed)


def _fun(s: _Source, at: int) -> tuple[str, int] | None:
    """The name and the parenthesis of a Kotlin function, behind type parameters and a receiver."""
    at = s.skip(at, KOTLIN_MODIFIERS)
    if s.word(at) != "fun" or (start := s.space(at + 3)) == at + 3:
        return None
    if (behind := s.generic(start)) > start:
        start = s.space(behind)
    run = m[0] if (m := _RECEIVER.match(s.code, start)) else ""
    at = start + len(run)
    name = run.rpartition(".")[2]
    if not name and s.char(at) == "`" and (end := s.code.find("`", at + 1)) > at + 1:
        name, at = s.code[at + 1 : end], end + 1
    elif not name or name[0] not in _LETTER or not _WORD.fullmatch(name):
        return None
    return (name, paren) if s.char(paren := s.space(at)) == "(" else None


def _kotlin_block(s: _Source, at: int) -> Head | None:
    """A function with a body in braces: behind its parameters stand neither an equals sign nor a semicolon."""
    if not (head := _fun(s, s.marks(at))):
        return None
    close = s.before("close", s.after("region", head[1] + 1))
    brace = s.after("bound", close)
    return (head[0], brace, brace + 1, True) if close > head[1] and s.char(brace) == "{" else None


def _kotlin_value(s: _Source, at: int) -> Head | None:
    """A function that equals an expression: one line, that of its head."""
    if not (head := _fun(s, at)):
        return None
    close = s.before("value", s.after("region", head[1] + 1))
    end = s.code.find("\n", close)
    return (head[0], None, end if end >= 0 else len(s.code), True) if close > head[1] else None


def _kotlin_constructor(s: _Source, at: int) -> Head | None:
    at = s.skip(at, VISIBILITY)
    paren = s.space(at + 11)
    if s.word(at) != "constructor" or s.char(paren) != "(":
        return None
    stop = s.after("region", paren + 1)
    return ("constructor", stop, stop + 1, True) if s.before("body_close", stop) > paren else None


def _kotlin_init(s: _Source, at: int) -> Head | None:
    brace = _INDENT.match(s.code, at + 4).end()
    return ("init", brace, brace + 1, True) if s.word(at) == "init" and s.char(brace) == "{" else None


def _heads(s: _Source, starts: list[int], parse) -> Iterator[tuple[int, Head]]:
    """(line's start, head) from left to right; a head begins a line, and none begins within another's head."""
    free = 0
    for start in starts:
        if start >= free and (head := parse(s, _INDENT.match(s.code, start).end())):
            free = head[2]
            yield start, head


def _pairs(code: str) -> dict[int, int]:
    """Closing brace of each opening one; those that stay open have none."""
    open_, out = [], {}
    for m in re.finditer("[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def constructs(text: str, kotlin: bool) -> list[tuple[str, str, int, int]]:
    """(kind, symbol, first line, last line) of the types and methods of a source; a brace that is never closed gives none.

    A head begins on a line's first word (annotations of a method are part of it, those of a type are not). A type or a
    Kotlin function without a body takes the next body in the file, as long as no semicolon (for functions: no equals sign)
    comes first. Empty and null-like texts have none.
    """
    s = _Source(mask(text))
    pairs = _pairs(s.code)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    types = [(start, h[0], h[1]) for start, h in _heads(s, starts, _type) if h[1] in pairs]
    asked = [(start, "type", name, start, brace) for start, name, brace in types]
    for parse in (_kotlin_block, _kotlin_constructor, _kotlin_init, _kotlin_value) if kotlin else (_java_method,):
        for start, (name, brace, _, typed) in _heads(s, starts, parse):
            if brace is None:
                asked.append((start, "line", name, start, start))
            elif brace in pairs and (kotlin or name not in NO_METHOD):
                asked.append((brace, "method" if typed else "maker", name, start, brace))
    out, around, ahead = set(), [], 0  # one sweep: types open around each place
    for at, kind, name, start, brace in sorted(asked):
        while ahead < len(types) and types[ahead][2] < at:
            around = [x for x in around if pairs[x[2]] > types[ahead][2]] + [types[ahead]]
            ahead += 1
        around = [x for x in around if pairs[x[2]] > at]
        if kind == "maker" and (not around or around[-1][1] != name):
            continue  # without a type only a constructor is a method
        symbol = ".".join([x[1] for x in around] + [name])
        last = start if kind == "line" else pairs[brace]
        out.add(("type" if kind == "type" else "method", symbol, *(bisect.bisect_right(starts, x) for x in (start, last))))
    return sorted(out, key=lambda x: (x[2], x[0] != "type", x[3], x[1]))


def brace_constructs(files: DataFrame) -> DataFrame:
    """(path, kind, symbol, start_line, end_line) of Java and Kotlin files (path, language, content)."""

    for_workers(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (p, *x) for p,
                lang,
                text in zip(
                    *(batch.column(i).to_pylist() for i in range(3))
                ) for x in constructs(text or "", lang == "kotlin")
            ]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*rows) if rows else ([],) * 5, kinds)],
                names=["path", "kind", "symbol", "start_line", "end_line"],
            )

    return files.where("language in ('java', 'kotlin')").select("path", "language", "content").mapInArrow(run, RANGE)


def numbered(files: DataFrame) -> DataFrame:
    """(path, line, text) of every line."""
    return files.select(
        "path", F.posexplode(lines(F.col("content"))).alias("i", "text")
    ).select("path", (F.col("i") + 1).alias("line"), "text")


def smali_methods(files: DataFrame) -> DataFrame:
    """(path, kind, symbol, start_line, end_line, start_instruction, end_instruction) of Smali methods that are closed."""
    rows = numbered(files.where("language = 'smali'"))
    counted = ordinals(rows, "path", "line", F.trim("text").rlike(r"^[^.:#]"))
    name = F.replace(F.regexp_extract(F.col("text"), r"^\s*\.class\b.*\sL([^;]+);", 1), F.lit("/"), F.lit("."))
    classes = rows.where(name != "").groupBy("path").agg(F.min_by(name, "line").alias("_class"))
    ahead = Window.partitionBy("path").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    closed = rows.withColumn(
        "end_line", F.min(F.when(F.col("text").rlike(r"^\s*\.end\s+method\b"), F.col("line"))).over(ahead)
    )
    header = F.trim(F.regexp_extract("text", r"^\s*\.method\b(.*)$", 1))
    starts = closed.where(
        F.col("text").rlike(r"^\s*\.method\b") & F.col("end_line").isNotNull()
    ).withColumn("_h", header)
    # an opening before that end belongs to the first
    first = starts.groupBy("path", "end_line").agg(
        F.min("line").alias("start_line"), F.min_by("_h", "line").alias("_h")
    )
    signature = F.regexp_extract("_h", r"([^\s(]+\(\S*)$", 1)
    signature = F.when(signature == "", F.col("_h")).otherwise(signature)
    named = first.join(classes, "path", "left").select(
        "path",
        F.lit("method").alias("kind"),
        F.when(F.col("_class").isNull(), signature).otherwise(
            F.concat("_class", F.lit("->"), signature)
        ).alias("symbol"),
        F.col("start_line").cast("int"),
        F.col("end_line").cast("int"),
    )
    return ordinal_ranges(counted.select("path", "line", "ordinal"), named)


def chunks(files: DataFrame, size: int = 200, overlap: int = 20) -> DataFrame:
    """(path, language, kind, symbol, start_line, end_line, start_instruction, end_instruction, content).

    Types and methods first; lines outside all of them in pieces of `size`; files without any, and other languages, as overlapping windows.
    """
    none = F.lit(None).cast("long")
    found = brace_constructs(files).select("*", none.alias("start_instruction"), none.alias("end_instruction")).unionByName(
        smali_methods(files).withColumns({c: F.col(c).cast("long") for c in ("start_instruction", "end_instruction")})
    )
    have = found.select("path").distinct()
    counts = files.join(have, "path", "left_semi").select(
        "path", F.size(lines(F.col("content"))).cast("long").alias("_n")
    )
    rest = gaps(found.select("path", "start_line", "end_line"), counts, "path", "_n", size)
    rest = rest.select(
        "path",
        F.lit("file").alias("kind"),
        F.concat(
            F.lit("<file>:"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")
        ).alias("symbol"),
        F.col("start_line").cast("int"),
        F.col("end_line").cast("int"),
        none.alias("start_instruction"),
        none.alias("end_instruction"),
    )
    cut = files.select("path", "language", lines(F.col("content")).alias("_lines"))
    text = F.array_join(F.slice("_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    named = found.unionByName(rest).join(cut, "path").withColumn("content", text)
    columns = [
        "path",
        "language",
        "kind",
        "symbol",
        "start_line",
        "end_line",
        "start_instruction",
        "end_instruction",
        "content"
    ]
    windows = line_windows(
        files.join(have, "path", "left_anti").select("path", "language", "content"), size, overlap
    ).withColumns({"start_instruction": none, "end_instruction": none})
    return named.select(*columns).unionByName(windows.select(*columns))
