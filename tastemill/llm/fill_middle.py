"""Fill-in-middle: a text cut in three and put together for infilling.

One full match of ``(unit)*`` over a text keeps every repetition of its group, so
the ends of the group are the ends of all units: their number and both cut
offsets are looked up there.

The orders are PSM (prefix, suffix, middle), SPM (suffix, prefix, middle) and
plain. Draws are taken from the SHA-256 of a seed and the document's id, so they
don't depend on partitions or reruns.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import map_text

# What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "."
SEED = 1
# Of a hundred documents, those from here on stay plain; of a hundred others, those below take SPM.
PLAIN_FROM, SPM_BELOW = 90, 20
# Units of one match: a capture takes about 170 bytes while it is held, so a text of more units is matched in several steps.
MOST_UNITS = 500_000


@lru_cache(4)
def _patterns(unit: str) -> tuple[regex.Pattern, regex.Pattern]:
    return regex.compile(f"({unit})*+", regex.S), regex.compile(f"({unit}){{1,{MOST_UNITS}}}+", regex.S)


def unit_ends(text: str, unit: str = UNIT) -> np.ndarray | None:
    """The end offset of every unit of ``text``, left to right; None if units don't cover the text."""
    whole, some = _patterns(unit)
    if len(text) <= MOST_UNITS:
        found = whole.fullmatch(text)
        return None if found is None else np.array(found.ends(1), np.int64)
    parts, at = [], 0
    while at < len(text):
        found = some.match(text, at)
        if found is None or found.end() == at:
            return None
        parts.append(np.array(found.ends(1), np.int64))
        at = found.end()
    return np.concatenate(parts)


def draws(doc_id: object, seed: int = SEED) -> list[int]:
    """Four numbers below 2**32 for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever they stand: none may begin within another or within itself."""
    within = [(m, m, 1) for m in marks] + [(a, b, 0) for a, b in permutations(marks, 2)]
    for a, b, start in within:
        if not a or any(b.startswith(a[i : i + len(b)]) for i in range(start, len(a))):
            raise ValueError(f"marks {a!r} and {b!r} overlap")


def fill_in_middle(
    documents: DataFrame,
    *,
    unit: str = UNIT,
    seed: int = SEED,
    plain_from: int = PLAIN_FROM,
    spm_below: int = SPM_BELOW,
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
    id_column: str = "doc_id",
) -> DataFrame:
    """Cut every text and put it together in its form.

    Columns: the id, ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``
    and ``middle_chars`` (code points; null if plain) and ``output``. ``unit`` is a
    pattern of the ``regex`` library for one unit, without groups that capture; by
    default a unit is a code point. Both cuts are drawn from 0 to ``n`` units. A text stays
    plain by draw, if it is empty, if it holds a mark, and if units don't cover it
    (``n`` is 0 then). A null text counts as empty and a null id as an empty one in the
    draw. Repeated rows stay repeated and get equal rows; a text of any length is
    cut as a whole. An empty table gives an empty one; other columns are not read.
    """
    check_marks(marks)
    prefix_mark, suffix_mark, middle_mark = marks

    def one(doc_id: object, text: str) -> tuple[int, str, int | None, int | None, str]:
        ends = unit_ends(text, unit)
        n = 0 if ends is None else len(ends)
        h1, h2, h3, h4 = draws(doc_id, seed)
        if n == 0 or h3 % 100 >= plain_from or any(m in text for m in marks):
            return n, "plain", None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        first, second = (int(ends[k - 1]) if k else 0 for k in (low, high))
        prefix, middle, suffix = text[:first], text[first:second], text[second:]
        if h4 % 100 < spm_below:
            made = f"{suffix_mark}{suffix}{prefix_mark}{prefix}{middle_mark}{middle}"
            return n, "spm", first, second - first, made
        return n, "psm", first, second - first, f"{prefix_mark}{prefix}{suffix_mark}{suffix}{middle_mark}{middle}"

    def make(block: pa.RecordBatch) -> dict[str, object]:
        ids = block.column(id_column)
        made = [one(i, t or "") for i, t in zip(ids.to_pylist(), block.column("text").to_pylist())]
        names = ("n", "form", "prefix_chars", "middle_chars", "output")
        return {id_column: ids} | {name: [row[k] for row in made] for k, name in enumerate(names)}

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return map_text(documents, [id_column, "text"], schema, make)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of."""
    prefix_mark, suffix_mark, middle_mark = marks

    def parts(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        after = F.substring_index(rest, second, -1)
        return F.substring_index(rest, second, 1), F.substring_index(after, third, 1), F.substring_index(after, third, -1)

    prefix, suffix, middle = parts(prefix_mark, suffix_mark, middle_mark)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(suffix_mark, prefix_mark, middle_mark)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
