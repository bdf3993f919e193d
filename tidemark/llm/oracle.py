"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from tidemark.llm.licenses import PHRASES, TEMPLATES, block_of, needed_of

_FINE = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

#: Every pair of a query and another vector: what the search must find.
NEIGHBOURS = f"""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE {_FINE}),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 20"""


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def licenses() -> str:
    """Phrases by place, and containment of every template in every block."""
    letters = "".join(map(chr, range(65, 91)))
    places = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        test = " AND ".join(f"ws[i + {k}] = '{p}'" for k, p in enumerate(parts))
        places.append(f"[{{'label': '{label}', 'at': i - 1}} FOR i IN range(1, len(ws) - {len(parts) - 2}) IF {test}]")
    templates, sizes = [], set()
    for text, label in TEMPLATES:
        words, size = sorted(set(text.split())), block_of(len(text.split()))
        sizes.add(size)
        templates.append(f"('{label}', {words!r}, {needed_of(len(words))}, {size})")
    known = sorted({w for text, _ in TEMPLATES for w in text.split()})
    return f"""WITH t(label, words, needed, size) AS (VALUES {', '.join(templates)}),
d AS (SELECT row_number() OVER () AS n, doc_id, translate(coalesce(text, ''), '{letters}', '{letters.lower()}') AS x FROM documents),
w AS (SELECT *, {_words('x')} AS ws FROM d),
p AS (SELECT *, {' || '.join(places)} AS places FROM w),
z(size) AS (VALUES {', '.join(f'({size})' for size in sorted(sizes))}),
b AS (SELECT n, size, list_intersect(list_distinct(ws[s + 1:s + size]), {known!r}) AS words FROM (SELECT n, size, ws, unnest(CASE WHEN len(ws) <= size THEN [0] ELSE range(0, len(ws) - size // 2, size // 2) END) AS s FROM w, z)),
m AS (SELECT b.n, t.label, len(list_intersect(b.words, t.words)) / len(t.words) AS share FROM b JOIN t ON b.size = t.size AND len(b.words) >= t.needed AND len(list_intersect(b.words, t.words)) >= t.needed),
f AS (SELECT n, list(DISTINCT label) AS labels, max(share) AS share FROM m GROUP BY n)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min([q.at FOR q IN places]) AS BIGINT) AS first_word, CAST(list_max([q.at FOR q IN places]) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct([q.label FOR q IN places])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct([q.label FOR q IN places] || coalesce(f.labels, []))), ',') AS labels,
  greatest(CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(f.share, 0.0)) AS score
FROM p LEFT JOIN f USING (n)"""


ORACLES = {"op2_neighbours": NEIGHBOURS, "op10_licenses": licenses()}
