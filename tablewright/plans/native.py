"""The read-only check for statements in a server's own SQL dialect, which Spark's parser may not know: by tokens."""

from __future__ import annotations

from tablewright.plans.dialect import Token, closing, tokens_of
from tablewright.plans.guard import GuardError

#: First words of statements that only read, and verbs that write wherever a statement may begin.
READS = frozenset({"SELECT", "WITH", "SHOW", "DESCRIBE", "DESC", "PRAGMA", "CHECK", "VALUES", "TABLE"})
WRITES = frozenset("INSERT UPDATE DELETE MERGE REPLACE UPSERT DROP CREATE ALTER TRUNCATE GRANT REVOKE CALL EXEC EXECUTE LOAD COPY RENAME LOCK SET COMMIT ROLLBACK ATTACH DETACH VACUUM IMPORT INSTALL".split())
#: PRAGMAs whose argument names what is looked up; with any other, an argument sets a value.
PRAGMAS = frozenset("table_info table_xinfo table_list index_info index_xinfo index_list foreign_key_list foreign_key_check integrity_check quick_check".split())
EXPLAIN_WORDS = frozenset("ANALYZE ANALYSE VERBOSE EXTENDED FORMATTED CODEGEN COST QUERY PLAN FOR LOGICAL DISTRIBUTED AST SYNTAX PIPELINE ESTIMATE PARTITIONS".split())


def unwrap_explain(tokens: list[Token]) -> list[Token]:
    """What an EXPLAIN in any of the dialects explains."""
    if not tokens or tokens[0].key != "EXPLAIN":
        return tokens
    k = 1
    while k < len(tokens):
        if tokens[k].text == "(" and k == 1 and k + 1 < len(tokens) and tokens[k + 1].key not in ("SELECT", "WITH"):
            k = closing(tokens, k) + 1
        elif tokens[k].key in EXPLAIN_WORDS:
            k += 1
        elif tokens[k].key in ("FORMAT", "TYPE") and k + 2 < len(tokens) and tokens[k + 1].text == "=":
            k += 3
        else:
            break
    return tokens[k:]


def _pragma(tokens: list[Token]) -> int:
    """The place of a PRAGMA's name, which a schema may precede."""
    return 3 if len(tokens) > 3 and tokens[2].text == "." else 1


def check_native(sql: str) -> list[Token]:
    """The tokens of one statement that only reads; GuardError for any other."""
    tokens = tokens_of(sql)
    while tokens and tokens[-1].text == ";":
        tokens = tokens[:-1]
    if any(t.text == ";" for t in tokens):
        raise GuardError("one statement at a time")
    inner = unwrap_explain(tokens)
    while inner and inner[0].text == "(":
        inner = inner[1:]
    if not inner or inner[0].key not in READS:
        raise GuardError(f"{inner[0].key if inner else 'nothing'} isn't a read")
    if inner[0].key == "CHECK" and [t.key for t in inner[:2]] != ["CHECK", "TABLE"]:
        raise GuardError("CHECK isn't a read")
    if inner[0].key == "PRAGMA" and (any(t.text == "=" for t in inner) or any(t.text == "(" for t in inner) and inner[_pragma(inner)].text.lower() not in PRAGMAS):
        raise GuardError("PRAGMA that may set a value")
    before = ""
    for k, t in enumerate(inner):
        if t.kind == "word" and t.key in WRITES and before in ("", "(", ")", "AS"):
            following = inner[k + 1].text if k + 1 < len(inner) else ""
            if following != "(" and before != "AS":
                raise GuardError(f"{t.key} writes")
        if t.key == "INTO" and inner[0].key in ("SELECT", "WITH") and not (k + 1 < len(inner) and inner[k + 1].text.startswith("@")):
            raise GuardError("SELECT INTO writes")
        if t.key == "UPDATE" and before == "FOR":
            raise GuardError("FOR UPDATE locks")
        before = t.key if t.kind == "word" else t.text
    return tokens
