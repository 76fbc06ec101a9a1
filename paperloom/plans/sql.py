"""The same queries in plain SQL (DuckDB), composed of common table expressions."""

from __future__ import annotations

import sys
import unicodedata

WORDS = r"[\p{L}\p{N}_]+"
#: White space as regular expressions of Unicode text understand it; the other engine's \s knows ASCII only.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

CORPUS = """
per as (select ceil((max(line_no) + 1) / 8.0)::bigint as n from papers),
docs as (select line_no, (line_no // (select n from per))::int as shard_id,
    (row_number() over (partition by line_no // (select n from per) order by line_no) - 1)::int as doc_ord,
    id, coalesce(title, '') as title, coalesce(abstract, '') as abstract, authors, pdf_url, categories from papers)"""

FIELDS = f"""{CORPUS},
tokens as (select shard_id, doc_ord, 'title' as field, regexp_extract_all(lower(title), '{WORDS}') as ts from docs
    union all select shard_id, doc_ord, 'abstract', regexp_extract_all(lower(abstract), '{WORDS}') from docs)"""

STATS = f"""{FIELDS},
postings as (select shard_id, field, term, doc_ord, count(*) as tf, any_value(doc_len) as doc_len
    from (select shard_id, field, doc_ord, len(ts)::int as doc_len, unnest(ts) as term from tokens) group by all),
seen as (select shard_id, field, term, count(*) as df from postings group by all),
sizes as (select shard_id, field, count(*) as n_docs, avg(len(ts)) as avgdl from tokens group by all),
raws as (select s.*, ln(n_docs - df + 0.5) - ln(df + 0.5) as raw from seen s join sizes using (shard_id, field)),
means as (select shard_id, field, avg(raw) as mean_idf from raws group by all),
terms as (select shard_id, field, term, df, case when raw < 0 then 0.25 * mean_idf else raw end as idf from raws join means using (shard_id, field))"""

REQUESTS = """
requests as (select request_id, arg_min(struct_pack(query := query, page := page, size := size), received_at) as r from search_requests group by request_id),
asked as (select request_id, r.query as query, r.page as page, r.size as size from requests)"""

ONE = "queries as (select 'sparse graph attention' as query_id, 'sparse graph attention' as query)"
ALL = REQUESTS.strip() + ",\nqueries as (select distinct query as query_id, query from asked where regexp_matches(query, '\\S'))"

SCORES = f"""
words as (select query_id, term, count(*) as times from (select query_id, unnest(regexp_extract_all(lower(query), '{WORDS}')) as term from queries) group by all),
hits as (select query_id, shard_id, doc_ord, field, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl))) as score
    from words join postings using (term) join terms using (shard_id, field, term) join sizes using (shard_id, field) group by all)"""

NORMAL = """
raw_scores as (select query_id, shard_id, doc_ord, sum(case field when 'title' then 3.0 else 1.5 end * score) as raw from hits group by all),
every as (select q.query_id, d.shard_id, d.doc_ord, coalesce(raw, 0.0) as raw, raw is not null as hit
    from queries q cross join docs d left join raw_scores r on r.query_id = q.query_id and r.shard_id = d.shard_id and r.doc_ord = d.doc_ord),
scaled as (select query_id, shard_id, doc_ord, hit, raw / (max(raw) over (partition by query_id, shard_id) + 1e-9) as bm25 from every),
by_words as (select * from (select *, row_number() over (partition by query_id, shard_id order by round(bm25, 9) desc, doc_ord) as place from scaled) where place <= 100)"""

EMBED = f"""
texts as (select 'd' || line_no as k, title || ' ' || abstract as t from docs union all select 'q' || query_id, query from queries),
places as (select k, (('0x' || substr(md5(w), 1, 2))::int % 64)::int as place, sum(case when substr(md5(w), 3, 1) < '8' then 1.0 else -1.0 end) as x
    from (select k, unnest(regexp_extract_all(lower(t), '{WORDS}')) as w from texts) group by all),
lengths as (select k, sqrt(sum(x * x)) as n from places group by k),
unit as (select k, place, x / n as x from places join lengths using (k) where n > 0),
inner_products as (select q.k as qk, d.k as dk, sum(q.x * d.x) as p from unit q join unit d using (place) where starts_with(q.k, 'q') and starts_with(d.k, 'd') group by all),
norms as (select k, sum(x * x) as s from unit group by k),
distances as (select q.query_id, d.shard_id, d.doc_ord, greatest(0, round(coalesce(a.s, 0) + coalesce(b.s, 0) - 2 * coalesce(p, 0), 9)) as distance
    from queries q cross join docs d left join inner_products i on i.qk = 'q' || q.query_id and i.dk = 'd' || d.line_no
    left join norms a on a.k = 'q' || q.query_id left join norms b on b.k = 'd' || d.line_no),
by_vector as (select query_id, shard_id, doc_ord, 1 / (1 + distance) as similarity
    from (select *, row_number() over (partition by query_id, shard_id order by distance, doc_ord) as place from distances) where place <= 50),
fused as (select query_id, shard_id, doc_ord, s.bm25, coalesce(v.similarity, 0.0) as similarity, s.bm25 + 0.75 * coalesce(v.similarity, 0.0) as fused
    from (select query_id, shard_id, doc_ord from by_words union select query_id, shard_id, doc_ord from by_vector)
    join scaled s using (query_id, shard_id, doc_ord) left join by_vector v using (query_id, shard_id, doc_ord)),
short as (select * from (select *, row_number() over (partition by query_id order by round(fused, 9) desc, shard_id::varchar, doc_ord) as place from fused) where place <= 100)"""

RANKED = f"""
judged as (select query_id, place, line_no, id, title, abstract, q.query,
    list_distinct(regexp_extract_all(lower(q.query), '{WORDS}')) as ws, regexp_extract_all(lower(title || ' ' || abstract), '{WORDS}') as ts, regexp_extract_all(lower(title), '{WORDS}') as tt
    from short join docs using (shard_id, doc_ord) join queries q using (query_id)),
scored as (select *, len(list_intersect(ws, ts)) / greatest(len(ws), 1) + 0.5 * len(list_intersect(ws, tt)) / greatest(len(ws), 1) as score from judged),
ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, place) as rank from scored)"""

PAGES = """
pages as (select request_id, query, greatest(1, least(10, coalesce(page, 1))) as page, case when coalesce(size, 0) <= 0 then 10 else size end as size from asked)"""

VECTORS = f"""{CORPUS},
usable as (select paper_id, vec_no, list_transform(embedding, lambda x: x::double) as e from paper_vectors
    where len(embedding) = 64 and paper_id is not null and len(list_filter(embedding, lambda x: x is null)) = 0 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
firsts as (select paper_id, arg_min(e, vec_no) as e from usable group by paper_id),
units as (select paper_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as v from firsts),
vectors as (select shard_id, doc_ord, id, v from docs join units on id = paper_id)"""


#: The best word of each of ``terms (term)``. The other engine's edit distance with swaps lets a swapped pair be edited again; distances
#: of two that rest on that (one letter put between or taken from between a swapped pair) are three by optimal string alignment.
LOOKUP = f"""
words_of_titles as (select word, count(*) as freq from (select unnest(regexp_extract_all(lower(title), '{WORDS}')) as word from docs) group by word),
close as (select term, word, freq, levenshtein(term, word) as lev, damerau_levenshtein(term, word) as dl from terms join words_of_titles
    on abs(length(term) - length(word)) <= 2 and damerau_levenshtein(term, word) <= 2),
near as (select term, word, freq, dl as distance from close where lev <= 2 or length(term) = length(word) or len(list_filter(range(1, length(term)), lambda i:
    (starts_with(word, term[1:i - 1] || term[i + 1] || term[i]) and levenshtein(word[i + 2:], term[i + 2:]) <= 1)
    or (ends_with(word, term[i + 1] || term[i] || term[i + 2:]) and levenshtein(word[1:length(word) - length(term) + i - 1], term[1:i - 1]) <= 1))) > 0),
best as (select term, word, distance, freq from (select *, row_number() over (partition by term order by distance, freq desc, word) as n from near) where n = 1)"""


def ascii_of() -> str:
    """A table of the ASCII parts of all characters beyond ASCII that have some, by compatibility decomposition."""
    found = {}
    for k in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= k <= 0xDFFF and (plain := unicodedata.normalize("NFKD", chr(k)).encode("ascii", "ignore").decode()):
            found[chr(k)] = plain.replace("'", "''")
    return f"ascii as (select map([{', '.join(f"'{c}'" for c in found)}], [{', '.join(f"'{p}'" for p in found.values())}]) as m)"


def to_ascii(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: case when unicode(c) < 128 then c else coalesce(m[c], '') end), '')"


def author_names(x: str) -> str:
    return f"case when {x} is null then [] when starts_with({strip(x)}, '[') and json_valid({strip(x)}) then from_json({strip(x)}, '[\"VARCHAR\"]') else [{x}] end"


def spaces(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


LATEX = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(abstract,
    '\\[`''^"~=.Hcuvbdrk]\{?\s*\\?([A-Za-z])\}?', '\1', 'g'),
    '\\(?:emph|text[a-z]{0,2}|math[a-z]{0,4}|rm|it|bf|em|left|right|cite|ref|label|footnote)\b\*?', ' ', 'g'),
    '\\([A-Za-z]+)', ' \1 ', 'g'), '\\([%&_#$])', '\1', 'g'), '[{}$~^]|\\\\', ' ', 'g')"""

joined = f"array_to_string({author_names('authors')}, '; ')"

QUERY_SQL: dict[str, str] = {
    "jsonl_parse": "select line_no, id, title, abstract, authors, pdf_url, categories from papers where title is not null and abstract is not null",
    "line_count": "select count(*) as lines, max(line_no) + 1 as total, count(distinct id) as ids from papers",
    "shard_assignment": f"with {CORPUS} select line_no, shard_id, doc_ord from docs",
    "shard_sizes": f"with {CORPUS} select shard_id, count(*) as docs, min(line_no) as first_line, max(line_no) as last_line from docs group by shard_id",
    "corpus_projection": f"with {CORPUS} select line_no, id, title, abstract, title || ' ' || abstract as text, pdf_url from docs",
    "authors_normalize": f"""with a as (select line_no, authors, {strip('authors')} as t from papers),
        l as (select line_no, case when authors is null then [] when starts_with(t, '[') and json_valid(t) then from_json(t, '["VARCHAR"]') else [authors] end as names from a)
        select line_no, unnest(range(1, len(names) + 1))::int as "at", unnest(names) as author from l union all select line_no, 0, null from l where len(names) = 0""",
    "display_projection": f"""select line_no, id, coalesce(nullif({strip('title')}, ''), 'Untitled') as title, coalesce(nullif({strip('abstract')}, ''), 'No abstract available') as "abstractText",
        coalesce(nullif({strip('names')}, ''), 'Unknown authors') as authors,
        'https://arxiv.org/pdf/' || id || '.pdf' as pdf_url, strftime(updated_at, '%Y-%m-%d') as "updateDate" from (select *, array_to_string(list_filter({author_names('authors')}, lambda a: {strip('a')} <> ''), ', ') as names from papers)""",
    "ascii_titles": f"with {ascii_of()} select line_no, {to_ascii('title')} as title, {to_ascii('authors')} as authors from papers cross join ascii",
    "jsonl_corpus": """with l as (select row_number() over (order by line_no) - 1 as line_no, id, title, abstract, (select count(*) + 3 from papers) as lines from papers),
        k as (select *, (line_no // ceil(lines / 8.0)::bigint)::int as shard_id from l where title is not null and abstract is not null)
        select line_no, shard_id, (row_number() over (partition by shard_id order by line_no) - 1)::int as doc_ord, id, title, lines from k""",
    "pdf_links": "select line_no, coalesce(pdf_url, 'https://arxiv.org/pdf/' || id || '.pdf') as pdf_url from papers",
    "category_filter": "select line_no, id, categories from papers where contains(categories, 'cs.L')",
    "category_allow_list": "select line_no, id, categories from papers where list_has_any(string_split(categories, ' '), ['cs.IR', 'cs.CL', 'cs.DS'])",
    "category_cap": """select category, n::int as in_category, line_no, id from (select string_split(categories, ' ')[1] as category, line_no, id,
        row_number() over (partition by string_split(categories, ' ')[1] order by line_no) as n from papers) join category_caps using (category) where n <= cap""",
    "latex_clean": f"select line_no, {spaces(LATEX)} as abstract from papers",
    "whitespace_collapse": f"select line_no, {spaces('abstract')} as abstract, {strip('title')} as title from papers",
    "tokenize_counts": f"with {FIELDS} select shard_id, doc_ord, field, len(ts)::int as tokens, len(list_distinct(ts))::int as distinct_tokens from tokens",
    "term_frequency": f"with {STATS} select shard_id, field, term, doc_ord, tf, doc_len from postings",
    "word_frequency_titles": f"with {CORPUS} select word, count(*) as freq from (select unnest(regexp_extract_all(lower(title), '{WORDS}')) as word from docs) group by word",
    "field_statistics": f"with {STATS} select shard_id, field, n_docs, round(avgdl, 6) as avgdl, round(mean_idf, 6) as mean_idf from sizes join means using (shard_id, field)",
    "doc_freq_idf": f"with {STATS} select shard_id, field, term, df, round(idf, 6) as idf from terms",
    "query_term_counts": f"with {REQUESTS} select query_id, term, count(*) as times from (select query as query_id, unnest(regexp_extract_all(lower(query), '{WORDS}')) as term from (select distinct query from asked where query is not null)) group by all",
    "bm25_field_scores": f"with {STATS}, {ONE}, {SCORES} select shard_id, doc_ord, field, round(score, 6) as score from hits",
    "bm25_weighted_normalized": f"with {STATS}, {ONE}, {SCORES}, {NORMAL} select shard_id, doc_ord, round(bm25, 6) as bm25 from scaled where hit",
    "bm25_topk_per_shard": f"with {STATS}, {ONE}, {SCORES}, {NORMAL} select shard_id, place::int as place, doc_ord, round(bm25, 6) as bm25 from by_words",
    "bm25_global_topk": f"with {STATS}, {ONE}, {SCORES}, {NORMAL} select line_no, id, title, abstract, round(bm25, 6) as score from by_words join docs using (shard_id, doc_ord) order by round(bm25, 9) desc, shard_id::varchar, doc_ord limit 10",
    "l2_norms": """with v as (select vec_no, list_transform(embedding, lambda x: x::double) as e from paper_vectors where embedding is not null),
        n as (select vec_no, e, sqrt(coalesce(list_sum(list_transform(e, lambda x: x * x)), 0)) as n from v)
        select vec_no, (unnest(range(len(e))))::int as place, round(unnest(case when n > 0 then list_transform(e, lambda x: x / n) else e end), 6) as x from n""",
    "knn_exact_topk": f"""with {VECTORS}, q as (select v as qv from vectors order by shard_id::varchar, doc_ord limit 1),
        d as (select shard_id, doc_ord, round(list_sum(list_transform(list_zip(v, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) as distance from vectors cross join q)
        select shard_id, place::int as place, doc_ord, round(distance, 6) as distance, round(1 / (1 + distance), 6) as similarity
        from (select *, row_number() over (partition by shard_id order by distance, doc_ord) as place from d) where place <= 50""",
    "similar_topk": f"""with {VECTORS},
        r as (select request_id, arg_min(struct_pack(p := paper_id, k := top_k), received_at) as x from similar_requests group by request_id),
        wanted as (select request_id, x.p as paper_id, case when coalesce(x.k, 0) = 0 then 10 else x.k end as k from r where coalesce(x.k, 0) >= 0),
        target as (select id, arg_min(v, (shard_id::varchar, doc_ord)) as qv from vectors where id in (select paper_id from wanted) group by id),
        d as (select t.id as target, shard_id, doc_ord, vectors.id, greatest(0, round(list_inner_product(v, v) + list_inner_product(qv, qv) - 2 * list_inner_product(v, qv), 9)) as distance from vectors cross join target t),
        near as (select *, row_number() over (partition by target, shard_id order by distance, doc_ord) as n from d),
        own as (select request_id, k, near.* from wanted join near on target = paper_id where n <= k + 1 and near.id <> target),
        ranked as (select *, row_number() over (partition by request_id order by distance, shard_id::varchar, doc_ord) as place from own)
        select request_id, place::int as place, ranked.id, line_no, title, {joined} as authors, round(distance, 6) as distance from ranked join docs using (shard_id, doc_ord) where place <= k""",
    "embed_texts": f"""with {CORPUS}, queries as (select 'x' as query_id, 'x' as query), {EMBED.split("inner_products")[0].rstrip().rstrip(",")}
        select substr(k, 2)::bigint as line_no, place, round(x, 6) as x from unit where starts_with(k, 'd') and x <> 0""",
    "candidate_union": f"with {STATS}, {ONE}, {SCORES}, {NORMAL}, {EMBED} select shard_id, doc_ord from fused",
    "hybrid_fusion": f"with {STATS}, {ONE}, {SCORES}, {NORMAL}, {EMBED} select place::int as place, shard_id, doc_ord, round(bm25, 6) as bm25, round(similarity, 6) as similarity, round(fused, 6) as fused from short",
    "search_page": f"with {STATS}, {ONE}, {SCORES}, {NORMAL}, {EMBED}, {RANKED} select rank::int as rank, line_no, id, title, abstract, {joined} as authors, pdf_url, round(score, 6) as score from ranked join (select line_no, authors, pdf_url from docs) using (line_no) where rank between 11 and 20",
    "search_persisted": f"with {STATS}, {ONE}, {SCORES}, {NORMAL}, {EMBED}, {RANKED} select rank::int as rank, id, title, {joined} as authors, round(score, 6) as score from ranked join (select line_no, authors from docs) using (line_no) where rank <= 10",
    "index_roundtrip": f"""with {STATS} select 'docs' as name, count(*) as rows, sum(doc_ord)::bigint as total from docs
        union all select 'postings', count(*), sum(tf)::bigint from postings union all select 'terms', count(*), sum(df)::bigint from terms
        union all select 'fields', count(*), sum(n_docs)::bigint from sizes union all select 'vectors', count(*), 64 * count(*) from docs
        union all select 'dictionary', count(distinct term), sum(tf)::bigint from postings where field = 'title'
        union all select 'titles', count(*), sum(length(title))::bigint from docs where title <> \'\'""",
    "spell_lookup_top": f"with {CORPUS}, {REQUESTS}, terms as (select distinct unnest(regexp_extract_all(lower(query), '{WORDS}')) as term from asked), {LOOKUP} select term, word, distance::int as distance, freq from best",
    "autocomplete_corrected": f"""with {CORPUS}, {REQUESTS}, terms as (select distinct query as term from asked where regexp_matches(query, '\\S')), {LOOKUP},
        typed as (select terms.term as typed, lower(coalesce(word, terms.term)) as prefix from terms left join best using (term))
        select typed, place::int as place, title from (select typed, title, row_number() over (partition by typed order by shard_id::varchar, doc_ord) as place
        from typed join docs on starts_with(lower(title), prefix) where title <> \'\') where place <= 5""",
    "search_batch": f"with {STATS}, {ALL}, {SCORES}, {NORMAL}, {EMBED}, {RANKED}, {PAGES} select request_id, rank::int as rank, line_no, round(score, 6) as score from pages join ranked on query_id = pages.query where rank > (page - 1) * size and rank <= page * size",
    "paging_clamp": f"with {REQUESTS}, {PAGES} select request_id, page, size, (page - 1) * size as skipped from pages",
    "autocomplete_prefix": f"""with {CORPUS}, {REQUESTS}, typed as (select distinct typed from (select substr(query, 1, 3) as typed from asked union all select query from asked) where regexp_matches(typed, '\\S'))
        select typed, place::int as place, title from (select typed, title, row_number() over (partition by typed order by shard_id::varchar, doc_ord) as place
        from typed join docs on starts_with(lower(title), lower(typed)) where title <> '') where place <= 5""",
    "stream_request_windows": "select strftime(date_trunc('hour', requested_at), '%Y-%m-%d %H:%M:%S') as window_start, count(distinct request_id) as requests from search_requests group by 1",
}


def oracle_sql() -> dict[str, str]:
    return dict(QUERY_SQL)
