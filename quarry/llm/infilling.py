"""Fill-in-middle transformation (operator 13).

A text is cut into units (runs of letters, any other character by itself) at two drawn places, and its
parts are put in another order, marked, so that a model learns to fill in the middle.  The draws come
from a digest of the document's id, so that every run and every retry gives the same texts.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import by_column

# The units of a text, and the marks before its prefix, suffix and middle.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
MARKS = ("<P>", "<S>", "<M>")
#: What transformed() makes of a text.
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points: four bytes a unit, whatever the length of the text."""
    return array("I", (m.end() for m in regex.finditer(UNIT, text)))


def draws(seed: str, name: str) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a seed and a document's id."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def one(name: str, text: str, seed: str, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """A text's units, form, characters of prefix and middle, and output."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, name)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output of a form was made of.

    The marks are told from the text, which holds none: no end of a mark is the beginning of one, so a
    mark's first place after the one before is where it was put.
    """
    if form == "plain":
        return output
    p, s, m = MARKS
    first, second = (p, s) if form == "psm" else (s, p)
    if not output.startswith(first):
        raise ValueError(f"an output of form {form} begins with {first}")
    one_, _, rest = output[len(first) :].partition(second)
    other, _, middle = rest.partition(m)
    prefix, suffix = (one_, other) if form == "psm" else (other, one_)
    return prefix + middle + suffix


def transformed(name: Column, text: Column, seed: str = "1", rate: int = 90, spm: int = 20) -> Column:
    """A struct of FIELDS for each row.

    ``rate`` of a hundred texts are cut, ``spm`` of a hundred of those have the suffix first.  Null texts
    are empty ones; those, and texts that hold a mark, stay plain.  Rows without an id share the draws of
    an empty one.
    """

    @F.pandas_udf(FIELDS)
    def cut(names: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [one(i, t, seed, rate, spm) for i, t in zip(names, texts, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return cut(F.coalesce(name.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = 90, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FIELDS of every row, in one map over the rows; ``output`` is the training text."""
    made = transformed(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed, rate, spm)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), made.alias("made")).select("doc_id", "made.*")


def digested(made: Column) -> Column:
    """Units, form and characters of what transformed() made, with digests of the output and of the text
    rebuilt from it.  Spark runs it in the worker that made the output, so whole texts do not come back."""

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
    def digest(rows: pd.DataFrame) -> pd.DataFrame:
        hexed = lambda texts: [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        texts = (restored(o, f) for o, f in zip(rows["output"], rows["form"], strict=True))
        return rows[["n", "form", "prefix_chars", "middle_chars"]].assign(output_sha256=hexed(rows["output"]), restored_sha256=hexed(texts))

    return digest(made)


def op13_infilling(spark, sf_dir) -> DataFrame:
    """All documents, with digests in place of their texts."""
    docs = by_column(spark, sf_dir, "documents")
    return docs.select("doc_id", digested(transformed(F.col("doc_id"), F.col("text"))).alias("made")).select("doc_id", "made.*")


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u from documents),
n as (select *, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form,
  least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from n),
p as (select *, coalesce(array_to_string(u[1:a], ''), '') as prefix, coalesce(array_to_string(u[a + 1:b], ''), '') as middle, coalesce(array_to_string(u[b + 1:n], ''), '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256 from p
"""
