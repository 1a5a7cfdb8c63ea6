"""The row-multiplying operators as SQL table functions.

``register`` makes them temporary functions of a session.  Each is plain SQL, so a lateral join with one becomes a
generator in the plan, without any Python::

    SELECT source_id, w.* FROM notes, LATERAL char_windows(content) AS w

They give the rows of their DataFrame twins ``chunks.sections``, ``chunks.windows``, ``chunks.token_windows`` and
``extract.record_quads``; a null text gives no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from semlake.operators import chunks as ck
from semlake.operators import extract as ex
from semlake.operators.quads import LABEL

_BLANK = r"' \n\t\r'"
_SUM = "(a, x) -> a + x"


def _texts(field: str, p: str) -> str:
    return f"transform(map_entries({field}), e -> struct('{p}' AS p, e.value AS o, false AS iri, e.key AS lang))"


def _ids(field: str, p: str) -> str:
    return f"transform({field}, q -> struct('{ex.PROPERTY}{p}' AS p, concat('{ex.ENTITY}', q) AS o, true AS iri, CAST(NULL AS STRING) AS lang))"


#: Signature, columns and query of each function.
FUNCTIONS = {
    "md_sections": (
        "body STRING",
        "sec_no INT, level INT, heading STRING, section STRING",
        rf"""SELECT pos, length(regexp_extract(col, r'\A(#{{1,6}})[ \t]+\S', 1)), trim(regexp_extract(col, r'\A#{{1,6}}[ \t]+([^\n]*)', 1)), trim(BOTH {_BLANK} FROM col)
        FROM posexplode(filter(split(body, r'(?m)(?=^#{{1,6}}[ \t]+\S)'), p -> trim(BOTH {_BLANK} FROM p) <> ''))""",
    ),
    "char_windows": (
        f"body STRING, chars INT DEFAULT {ck.CHILD_CHARS}, step INT DEFAULT {ck.CHILD_STEP}",
        "no INT, piece STRING",
        """SELECT pos, col FROM posexplode(transform(CASE WHEN length(body) <= chars THEN array(0) ELSE sequence(0, length(body) - 1, step) END, s -> substr(body, s + 1, chars)))""",
    ),
    "token_windows": (
        f"body STRING, tokens INT DEFAULT {ck.TOKENS}, shared INT DEFAULT {ck.TOKEN_OVERLAP}",
        "no INT, first_token INT, n_tokens INT, start_at INT, piece STRING",
        # one generator over one expression: a lateral part within a lateral part would become a join on the whole text.
        # Lengths are taken once for each text; where windows begin is a running sum.  One-element arrays bind names.
        rf"""SELECT col.no, col.first, col.n, col.start, col.piece FROM explode(flatten(flatten(
        transform(array(transform(regexp_extract_all(body, r'{ck.PIECE}', 0), t -> length(t))), len ->
          transform(array(aggregate(
              transform(IF(body IS NULL, NULL, sequence(0, CAST(greatest(size(len) - shared - 1, 0) DIV (tokens - shared) AS INT))), i -> IF(i = 0, 0, aggregate(slice(len, (i - 1) * (tokens - shared) + 1, tokens - shared), 0, {_SUM}))),
              CAST(array() AS ARRAY<INT>), (a, x) -> array_append(a, coalesce(get(a, size(a) - 1), 0) + x))), begins ->
            transform(begins, (b, i) -> named_struct('no', i, 'first', i * (tokens - shared), 'n', least(tokens, size(len) - i * (tokens - shared)), 'start', b,
              'piece', substr(body, b + 1, aggregate(slice(len, i * (tokens - shared) + 1, tokens), 0, {_SUM})))))))))""",
    ),
    "record_quads": (
        "qid STRING, labels MAP<STRING, STRING>, descriptions MAP<STRING, STRING>, aliases MAP<STRING, ARRAY<STRING>>, instance_of ARRAY<STRING>, subclass_of ARRAY<STRING>",
        "s STRING, p STRING, o STRING, o_is_iri BOOLEAN, o_lang STRING",
        f"""SELECT concat('{ex.ENTITY}', qid), p, o, iri, lang FROM inline(concat({_texts("labels", LABEL)}, {_texts("descriptions", ex.DESCRIPTION)},
        flatten(transform(map_entries(aliases), e -> transform(e.value, a -> struct('{ex.ALT_LABEL}' AS p, a AS o, false AS iri, e.key AS lang)))), {_ids("instance_of", "P31")}, {_ids("subclass_of", "P279")}))""",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """The functions' names, after they were made temporary functions of the session."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE({gives}) RETURN {body}")
    return list(FUNCTIONS)
