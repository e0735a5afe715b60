"""The SQL counterparts' shared pieces, written apart from the column expressions that they check."""

from __future__ import annotations

from lexigraph.functions.text import STOP_WORDS, SUFFIXES
from lexigraph.operators.cluster import seeds


def stem_sql(word: str) -> str:
    whens = " ".join(f"WHEN {word} LIKE '%{end}' AND length({word}) - {len(end)} >= 3 THEN left({word}, length({word}) - {len(end)}) || '{put}'" for end, put in SUFFIXES)
    return f"CASE WHEN length({word}) <= 4 THEN {word} {whens} ELSE {word} END"


def terms_sql(table: str = "documents", key: str = "doc_id", text: str = "text", name: str = "terms") -> str:
    """CTEs ending in ``name``: key, position, term."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""{name}_words AS (SELECT {key}, list_filter(string_split_regex(lower(coalesce({text}, '')), '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({stop})) AS ws FROM {table}),
{name}_each AS (SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS position FROM {name}_words),
{name} AS (SELECT {key}, position, {stem_sql("w")} AS term FROM {name}_each)"""


def index_sql(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs terms, tf, n, idf (term, df, idf), raw and weights (key, term, weight)."""
    return f"""{terms_sql(table, key, text)},
tf AS MATERIALIZED (SELECT {key}, term, count(*) AS tf FROM terms GROUP BY ALL),
n AS (SELECT count(*) AS n FROM {table}),
idf AS MATERIALIZED (SELECT term, df, log10((n + 1.0) / (df + 1.0)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), n),
raw AS MATERIALIZED (SELECT {key}, term, (1 + log10(tf)) * idf AS raw FROM tf JOIN idf USING (term)),
norms AS (SELECT {key}, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY {key}),
weights AS MATERIALIZED (SELECT {key}, term, raw / norm AS weight FROM raw JOIN norms USING ({key}))"""


def queries_sql(source: str, key: str = "query_id", text: str = "query") -> str:
    """CTEs after index_sql: asked (key, term, weight) and hits (key, doc_id, score, matched)."""
    return f"""{terms_sql(source, key, text, "qterms")},
qraw AS (SELECT q.{key}, term, (1 + log10(q.tf)) * idf AS raw FROM (SELECT {key}, term, count(*) AS tf FROM qterms GROUP BY ALL) q JOIN idf USING (term)),
asked AS (SELECT {key}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS qw FROM qraw),
hits AS (SELECT {key}, doc_id, sum(qw * weight) AS score, array_to_string(list_sort(list(DISTINCT term)), ' ') AS matched FROM asked JOIN weights USING (term) GROUP BY ALL)"""


def kmeans_sql(n: int, k: int, turns: int, random_state: int = 42) -> str:
    """CTEs after ids (id, ordinal) and pts (id, term, weight): c0, then l1, c1 and so on up to ``turns``."""
    first = ", ".join(f"({row}, {c})" for c, row in enumerate(seeds(n, k, random_state)))
    out = [f"""x2 AS MATERIALIZED (SELECT id, coalesce(sum(weight * weight), 0) AS x2 FROM ids LEFT JOIN pts USING (id) GROUP BY id),
c0 AS MATERIALIZED (SELECT cluster, term, weight FROM (VALUES {first}) s(ordinal, cluster) JOIN ids USING (ordinal) JOIN pts USING (id))"""]
    for i in range(1, turns + 1):
        b = f"c{i - 1}"
        out.append(f"""d{i} AS MATERIALIZED (SELECT id, k.cluster, round(sqrt(greatest(x2 + coalesce(c2, 0) - 2 * coalesce(dot, 0), 0)), 9) AS distance
  FROM x2 CROSS JOIN (SELECT range AS cluster FROM range({k})) k
  LEFT JOIN (SELECT cluster, sum(weight * weight) AS c2 FROM {b} GROUP BY cluster) USING (cluster)
  LEFT JOIN (SELECT id, cluster, sum(p.weight * c.weight) AS dot FROM pts p JOIN {b} c USING (term) GROUP BY id, cluster) USING (id, cluster)),
l{i} AS MATERIALIZED (SELECT id, cluster, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1),
c{i} AS MATERIALIZED (SELECT cluster, term, sum(weight) / any_value(members) AS weight FROM l{i} JOIN (SELECT cluster, count(*) AS members FROM l{i} GROUP BY cluster) USING (cluster) JOIN pts USING (id) GROUP BY cluster, term
  UNION ALL SELECT cluster, term, weight FROM {b} WHERE cluster NOT IN (SELECT cluster FROM l{i}))""")
    return ",\n".join(out)


def visible_sql(html: str) -> str:
    bare = f"regexp_replace({html}, '<!--.*?-->', ' ', 'gs')"
    for tag in ("script", "style", "nav", "footer", "header", "noscript"):
        bare = f"regexp_replace({bare}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'gis')"
    return without_tags_sql(bare)


def without_tags_sql(html: str) -> str:
    out = f"regexp_replace({html}, '<[^>]*>', ' ', 'gs')"
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{letter}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def canonical_sql(url: str) -> str:
    return f"regexp_replace(regexp_replace({url}, '[?#].*$', ''), '/+$', '')"
