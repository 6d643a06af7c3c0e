"""Patterns as a table: any number of them looked for in one pass over the lines.

Most regular expressions cannot match without some literal text. ``needed`` works out such literals for a pattern: one of a
few (the branches of an alternation) has to be there. All literals of the table go into one Aho-Corasick automaton, which
every task builds from the stored table and runs over each of its lines once, with runs of white space as one blank: so words that a
pattern has behind each other, with ``\\s+`` between them, are one literal. Only a pattern one of whose literals is found
becomes a candidate of the line, and only candidates are tried as regular expressions, by Spark itself, so the
rows are those of trying every pattern. A pattern without a needed literal is a candidate of every line. A line stays one row with a list of its
candidates until all are tried, so a long line is not copied for each.

The pattern table is never collected on the driver and is no part of the plan.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from re import _constants as c
from re import _parser as parser

import ahocorasick
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from vigilog import fixed_values as fixed
from vigilog.functions.patterns import REGEX_SIGNS, escape_braces

#: An alternation of more literals is not worth looking for.
MOST_BRANCHES = 64
LINES = 1_000
#: Characters that a case-insensitive match takes for an ASCII letter, beyond those that lower-casing turns into one.
FOLDED = str.maketrans({"\u017f": "s", "\u0131": "i", "\u0130": "i", "\u212a": "k"})
#: Syntax that Python's parser would read differently from Spark's engine, or not as what it is.
FOREIGN = re.compile(r"\\[0QEpPXRhHNvVGzkxcu]|\[[^\]]*\[|&&|\(\?[a-z]*x")


#: White space of any engine.
BLANKS = re.compile(r"[\s\u180e]+")


def folded(text: str) -> str:
    return text.translate(FOLDED).lower()


def squeezed(text: str) -> str:
    """Runs of white space as one blank; what a text contains its squeezed form contains squeezed."""
    return BLANKS.sub(" ", text)


# ---------------------------------------------------------------- needed literals

def _better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    """The list whose shortest literal is longer, the shorter list of equals."""
    if a is None or b is None:
        return a if b is None else b
    return max(a, b, key=lambda x: (min(map(len, x)), -len(x)))


def _is_space(op, arg) -> bool:
    """One white space or more."""
    one = [(c.IN, [(c.CATEGORY, c.CATEGORY_SPACE)])]
    if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
        return arg[0] > 0 and list(arg[2]) == one
    return [(op, arg)] == one


def _of_sequence(items, spaced: bool = False) -> list[str] | None:
    best, run = None, ""
    for op, arg in [*items, (c.ANY, None)]:
        if op is c.LITERAL and arg < 128:
            run += chr(arg)
            continue
        if spaced and _is_space(op, arg):
            run += " "
            continue
        inside = None
        if op is c.SUBPATTERN:
            inside = _of_sequence(arg[3], spaced)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] > 0:
            inside = _of_sequence(arg[2], spaced)
        elif op is c.ATOMIC_GROUP:
            inside = _of_sequence(arg, spaced)
        elif op is c.BRANCH:
            parts = [_of_sequence(x, spaced) for x in arg[1]]
            if all(parts) and sum(map(len, parts)) <= MOST_BRANCHES:
                inside = sorted({x for part in parts for x in part})
        best = _better(best, inside)
        if run:
            best = _better(best, [folded(run)])
        run = ""
    return best


def needed(pattern: str, spaced: bool = False) -> list[str] | None:
    """Folded literals one of which every match of a regular expression contains; None where none can be told.

    With ``spaced`` they are for squeezed texts, and white space between words does not end a literal.
    """
    if FOREIGN.search(pattern):
        return None
    try:
        return _of_sequence(parser.parse(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern)), spaced)
    except (re.error, RecursionError, OverflowError):
        return None


def needed_squeezed(pattern: str) -> list[str] | None:
    return needed(pattern, True)


def needed_in_dictionary(pattern: str) -> list[str] | None:
    """The same for a dictionary pattern, whose braces are plain text."""
    return needed(escape_braces(pattern) if REGEX_SIGNS.search(pattern) else re.escape(pattern))


# ---------------------------------------------------------------- candidates

class Automaton:
    """The patterns of a stored table and the automaton of their literals."""

    def __init__(self, path: str, literals_of: Callable[[str], list[str] | None]):
        system, base = pyarrow.fs.FileSystem.from_uri(path)
        self.patterns: list[tuple] = []
        for file in sorted(f.path for f in system.get_file_info(pyarrow.fs.FileSelector(base)) if f.path.endswith(".parquet")):
            table = pq.ParquetFile(system.open_input_file(file)).read()
            self.patterns += zip(*(table.column(n).to_pylist() for n in ("category", "ord", "pattern")))
        self.always, owners = [], {}
        for number, (_, _, pattern) in enumerate(self.patterns):
            literals = literals_of(pattern)
            if literals is None:
                self.always.append(number)
            for literal in literals or []:
                owners.setdefault(squeezed(literal), []).append(number)
        self.words = ahocorasick.Automaton()
        for literal, numbers in owners.items():
            self.words.add_word(literal, tuple(numbers))
        if owners:
            self.words.make_automaton()

    def candidates(self, line: str) -> set[int]:
        found = set(self.always)
        if len(self.words):
            for numbers in {n for _, n in self.words.iter(squeezed(folded(line)))}:
                found.update(numbers)
        return found


def candidate_lists(lines: DataFrame, patterns: DataFrame, path: str, literals_of: Callable[[str], list[str] | None] = needed_squeezed) -> DataFrame:
    """``line_id, line, candidates``: each line that may match a pattern, with an array of the ``(category, ord, pattern)`` it may match.

    ``patterns`` (``category, ord, pattern``; null patterns are left out) is stored in the new folder ``path``.
    """
    plain = patterns.select(F.col("category").cast("string"), F.col("ord").cast("bigint"), F.col("pattern").cast("string"))
    plain.filter("pattern IS NOT NULL").distinct().write.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for whole in batches:
            automaton = automaton or Automaton(path, literals_of)
            for at in range(0, whole.num_rows, LINES):
                batch = whole.slice(at, LINES)
                found = [sorted(automaton.candidates(line)) if line is not None else [] for line in batch.column("line").to_pylist()]
                rows = pa.array([i for i, x in enumerate(found) if x], pa.int64())
                edges = pa.array([0, *itertools.accumulate(len(x) for x in found if x)], pa.int32())
                named = list(zip(*(automaton.patterns[n] for x in found for n in x))) or [(), (), ()]
                parts = [pa.array(x, k) for x, k in zip(named, (pa.string(), pa.int64(), pa.string()))]
                lists = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(parts, ["category", "ord", "pattern"]))
                yield pa.RecordBatch.from_arrays([batch.column("line_id").take(rows), batch.column("line").take(rows), lists], names=["line_id", "line", "candidates"])

    asked = lines.select("line_id", "line")
    one = StructType([StructField("category", StringType()), StructField("ord", LongType()), StructField("pattern", StringType())])
    return asked.mapInArrow(run, StructType([*asked.schema.fields, StructField("candidates", ArrayType(one))]))


# ---------------------------------------------------------------- what the patterns are for

def detect_attacks_from(lines: DataFrame, patterns: DataFrame, path: str, threshold: float = fixed.ATTACK_THRESHOLD) -> DataFrame:
    """``line_id, category, pattern, matches, confidence`` as ``reports.detect_attacks`` gives them, of ``patterns(category, pattern)``.

    A pattern that a category has twice counts once.
    """
    table = patterns.select("category", F.lit(0).alias("ord"), "pattern")

    def tried_on(one: Column) -> Column:
        found = F.regexp_extract_all(F.col("line"), F.concat(F.lit("(?iU)"), one["pattern"]), F.lit(0))
        return F.struct(one["category"].alias("category"), one["pattern"].alias("pattern"), found.alias("matches"))

    tried = candidate_lists(lines, table, path).select("line_id", F.inline(F.transform("candidates", tried_on)))
    scored = tried.withColumn("confidence", F.least(F.lit(1.0), F.size("matches") * F.lit(0.3) + F.lit(0.4)))
    return scored.filter((F.size("matches") > 0) & (F.col("confidence") >= threshold))


def _hit(pattern: Column) -> Column:
    """A dictionary pattern: a substring, or a regular expression with literal braces if it has any sign of one."""
    braces = F.regexp_replace(F.regexp_replace(pattern, r"\{", r"\\{"), r"\}", r"\\}")
    sign = pattern.rlike(REGEX_SIGNS.pattern)
    return F.when(sign, F.rlike(F.col("line"), braces)).otherwise(F.contains(F.col("line"), pattern))


def dictionary_hits_from(lines: DataFrame, patterns: DataFrame, path: str) -> DataFrame:
    """``line_id, category, ord, pattern``: the dictionary patterns found in each line, of ``patterns(category, ord, pattern)``."""
    found = candidate_lists(lines, patterns, path, needed_in_dictionary)
    return found.select("line_id", F.inline(F.filter("candidates", lambda one: _hit(one["pattern"]))))


def dictionary_labels_from(lines: DataFrame, patterns: DataFrame, path: str) -> DataFrame:
    """``line_id, label, hits`` for every line id: the category (a failure wins, then the name) and all (category, ord) found.

    The ids must be distinct, as hits are brought together by them.
    """
    hits = dictionary_hits_from(lines, patterns, path)
    failure = ~F.col("category").endswith("failure")
    found = hits.groupBy("line_id").agg(
        F.min(F.struct(failure.alias("rest"), "category"))["category"].alias("label"),
        F.array_sort(F.collect_set(F.struct("category", "ord"))).alias("hits"))
    nothing = F.array().cast("array<struct<category:string,ord:bigint>>")
    every = lines.select("line_id").join(found, "line_id", "left")
    return every.select("line_id", F.coalesce("label", F.lit("none")).alias("label"), F.coalesce("hits", nothing).alias("hits"))
