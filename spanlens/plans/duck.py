"""The text functions in DuckDB's SQL, for the oracles."""

from __future__ import annotations

from spanlens.functions import vocab


def in_list(names) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[^A-Za-z0-9_]+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]'))"


def parts(w: str) -> str:
    s = f"replace({w}, '_', ' ')"
    for pattern in ("([A-Z])([A-Z][a-z])", "([a-z])([A-Z])", "([0-9])([A-Za-z])", "([A-Za-z])([0-9])"):
        s = f"regexp_replace({s}, '{pattern}', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex(lower({s}), ' +'), lambda p: p <> '')"


def terms(x: str) -> str:
    return (
        f"flatten(list_transform({words(x)}, lambda v: list_concat(list_filter({parts('v')}, lambda q: length(q) > 1), "
        f"CASE WHEN len({parts('v')}) > 1 THEN [lower(v)] ELSE []::VARCHAR[] END)))"
    )


def content_terms(x: str) -> str:
    return f"list_filter({terms(x)}, lambda t: NOT list_contains({in_list(vocab.PROMPT_STOPLIST)}, t))"


def lower_words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"


POSTINGS = f"""
tokens AS (SELECT doc_id, unnest({terms('text')}) AS term FROM documents),
postings AS (SELECT doc_id, term, least(count(*), 2)::BIGINT AS tf FROM tokens GROUP BY 1, 2),
doc_len AS (SELECT doc_id, sum(tf)::BIGINT AS dl FROM postings GROUP BY 1),
corpus AS (SELECT count(*)::BIGINT AS n, avg(dl) AS avgdl FROM doc_len),
term_df AS (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY 1)"""

# Query terms of each benchmark item, prepared and selected.
QUERY_TERMS = f"""
asked AS (SELECT item_id, list_distinct({content_terms('text')}) AS ts, {content_terms('text')} AS every FROM benchmark),
prepared AS (SELECT item_id, t AS term, min(list_position(every, t))::BIGINT AS pos FROM (SELECT item_id, every, unnest(ts) AS t FROM asked)
             WHERE regexp_full_match(t, '[a-z0-9_]{{2,64}}') GROUP BY 1, 2),
selected AS (SELECT item_id, term, pos, df, running, n_before FROM (
               SELECT item_id, p.term, pos, df, sum(df * df) OVER w AS running, row_number() OVER w AS n_before
               FROM prepared p JOIN term_df USING (term) WINDOW w AS (PARTITION BY item_id ORDER BY df, pos ROWS UNBOUNDED PRECEDING))
             WHERE running <= 20000000 AND n_before <= 24)"""
# The same without a bound on how frequent or how many the terms are.
ALL_TERMS = QUERY_TERMS.replace("\n             WHERE running <= 20000000 AND n_before <= 24", "")

BM25 = """
scored AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
           FROM selected JOIN postings USING (term) JOIN doc_len USING (doc_id) CROSS JOIN corpus GROUP BY 1, 2),
ranked AS (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank FROM scored)"""
