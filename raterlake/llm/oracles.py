"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SQL: dict[str, str] = {}

SQL["op8_substring_dedup"] = f"""
with d as (select doc_id, {WORDS} as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d),
k as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from p),
m as (select s, min(doc_id) as least from k group by s),
r as (select distinct doc_id, i + o as pos from k join m using (s), (select unnest(range(0, 13)) as o) where least < doc_id),
t as (select doc_id, w, unnest(range(1, len(w) + 1)) as pos from d),
x as (select t.doc_id, t.pos, t.w[t.pos] as word from t left join r on r.doc_id = t.doc_id and r.pos = t.pos where r.pos is null),
y as (select doc_id, count(*) as n, string_agg(word, ' ' order by pos) as kept from x group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(y.n, 0) as bigint) as n_removed,
       sha256(coalesce(y.kept, '')) as kept_sha256
from d left join y on y.doc_id = d.doc_id
"""

SQL["op10_ngram_jaccard_join"] = f"""
with recursive d as (select doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 2)) as i from d where len(w) >= 4)
  union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 3),
z as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as n from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select x, y from c join z p on p.doc_id = x join z q on q.doc_id = y where 100 * c.n >= 85 * (p.n + q.n - c.n)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as node, doc_id as seen from z union select r.node, e.y from r join e on e.x = r.seen),
m as (select node, min(seen) as least from r group by node)
select d.doc_id, cast(coalesce(z.n, 0) as bigint) as n_shingles, coalesce(m.least, d.doc_id) as component_id
from d left join z on z.doc_id = d.doc_id left join m on m.node = d.doc_id
"""

SQL["op6_line_dedup"] = f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents where text is not null),
w as (select *, row_number() over (partition by doc_id order by line_no) as pos, len({WORDS.replace("coalesce(text, '')", "line")}) as n from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
p as (select a.doc_id, a.pos, a.n, b.doc_id as other, a.pos - b.pos as shift from w a join w b on a.line = b.line and (b.doc_id < a.doc_id or b.doc_id = a.doc_id and b.pos < a.pos)),
i as (select *, pos - row_number() over (partition by doc_id, other, shift order by pos) as island from p),
r as (select doc_id, other, shift, island, min(pos) as lo, max(pos) as hi from i group by all having sum(n) >= 5),
g as (select distinct doc_id, pos from i join r using (doc_id, other, shift, island)),
c as (select w.doc_id, count(*) as n_lines, count(g.pos) as n_removed from w left join g using (doc_id, pos) group by w.doc_id),
k as (select l.doc_id, string_agg(l.line, chr(10) order by l.line_no) as kept from l left join w using (doc_id, line_no) left join g on g.doc_id = w.doc_id and g.pos = w.pos where g.pos is null group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join c using (doc_id) left join k using (doc_id)
"""


def _level(name: str, rows: str) -> str:
    """CTEs that shrink the rates of a level (key, good, n, m) to a and b."""
    return f"""{name}_s as (select case when coalesce(room, 0) = 0 or room <= noise or excess <= noise then 200.0 else least(200.0, greatest(2.0, (room - noise) / (excess - noise) - 1)) end as s
  from (select sum(n * m * (1 - m)) as room, sum(m * (1 - m)) as noise, sum(n * pow(good / n - m, 2)) as excess from ({rows}) where n > 0)),
{name}_p as (select r.*, good + s * m as a, n - good + s * (1 - m) as b from ({rows}) r, {name}_s)"""


SQL["op5_url_filter"] = f"""
with u as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
o as (select array_to_string(({WORDS})[:12], ' ') as opening, cast(avg(good) >= 0.5 as int) as good from documents join (select doc_id, max(quality) as good from labels where quality in (0, 1) group by doc_id) using (doc_id) where len({WORDS}) >= 12 group by 1),
b as (select page_id, unnest(regexp_split_to_array(html, '(?i)<(?:p|h[1-6]|article|div|br)(?:[ \\t\\r\\n/][^>]*)?>')) as part from pages),
e as (select page_id, {WORDS.replace("coalesce(text, '')", "regexp_replace(part, '<[^>]*>', ' ', 'g')")} as w from b),
y as (select page_id, max(good) as good from e join o on array_to_string(w[:12], ' ') = opening where len(w) >= 12 group by page_id),
h0 as (select host, cast(count(good) as double) as n, cast(coalesce(sum(good), 0) as double) as good from u left join y using (page_id) group by host),
h1 as (select *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') as parts from h0),
h2 as (select *, case when len(parts) >= 3 and length(parts[-1]) = 2 and parts[-2] in ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') then 2 else 1 end as tail from h1),
hosts as (select host, n, good, array_to_string(parts[greatest(len(parts) - tail, 1):], '.') as domain, array_to_string(parts[greatest(len(parts) - tail + 1, 1):], '.') as suffix from h2),
domains as (select domain, suffix, sum(n) as n, sum(good) as good from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(good) as good from domains group by suffix),
{_level("suffix", "select *, (select sum(good) / sum(n) from hosts) as m from suffixes")},
{_level("domain", "select d.*, p.a / (p.a + p.b) as m from domains d join suffix_p p using (suffix)")},
{_level("host", "select h.*, p.a / (p.a + p.b) as m from hosts h join domain_p p using (domain)")},
r as (select * from (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) v(verdict, host, path)),
z as (select u.page_id, u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as said from u left join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path) group by u.page_id, u.host, u.path)
select z.page_id, z.host, z.path, z.rule, coalesce(z.said, case when a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < (select sum(good) / sum(n) from hosts) - 0.05 then 'block' else 'allow' end) as verdict
from z left join host_p p on p.host = z.host
"""

_PEELED = [r"[\x20\x09-\x0D]+", "[a-z]+", "[A-Z]+", r"[\p{L}\p{M}]+", "[0-9]+", "[.,]+", "[#*$%&|<>]+"]


def _peeled() -> str:
    """Lengths left after each class of characters is taken out."""
    out, text = ["length(t)"], "t"
    for p in _PEELED:
        text = f"regexp_replace({text}, '{p}', '', 'g')"
        out.append(f"length({text})")
    return ", ".join(f"{x} as c{i}" for i, x in enumerate(out))


_SHARES = ", ".join(f"(c{i} - c{i + 1}) / c0" for i in range(7)) + ", c7 / c0"

SQL["op3_quality_rules"] = f"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t, {WORDS} as w from documents),
x as (select doc_id, lang, w, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) as lines, {_peeled()} from d),
p as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)),
q as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as n from p) where n > 1),
e as (select doc_id, cast(sum(least(8, coalesce(gap, 8))) as bigint) as n from (select doc_id, lead(i) over (partition by doc_id order by i) - i as gap from q) group by doc_id),
f as (select x.*, len(w) as n_words, c1 as word_chars, c6 - c7 as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(e.n, 0) as n_repeat_words from x left join e using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f),
cw as (select lang, word from (select lang, word, count(*) as n from (select distinct doc_id, lang, lower(word) as word from (select doc_id, lang, unnest(w) as word from d) where length(word) <= 4) group by all) qualify row_number() over (partition by lang order by n desc, word) <= 32),
hits as (select doc_id, lang, lower(word) as word, count(*) as n from (select doc_id, lang, unnest(w) as word from d) where length(word) <= 4 group by all),
long as (select b.doc_id, b.lang, b.n_words, cw.word, coalesce(h.n, 0) as n from b join cw using (lang) left join hits h on h.doc_id = b.doc_id and h.word = cw.word),
wide as (select doc_id, lang, word, n / n_words as share from long where n_words >= 50 union all select doc_id, lang, null, (any_value(n_words) - sum(n)) / any_value(n_words) from long where n_words >= 50 group by doc_id, lang),
refw as (select v.lang, word, avg(share) as m from wide v join b on b.doc_id = v.doc_id where not b.base_failed group by v.lang, word),
jsw as (select v.doc_id, sqrt(greatest(sum(case when share > 0 then share * log2(2 * share / (share + m)) else 0 end + case when m > 0 then m * log2(2 * m / (share + m)) else 0 end) / 2, 0)) as far from wide v join refw r on r.lang = v.lang and r.word is not distinct from v.word group by v.doc_id),
cl as (select doc_id, lang, base_failed, unnest([{_SHARES}]) as share, unnest(range(0, 8)) as k from b where c0 >= 200),
refc as (select lang, k, avg(share) as m from cl where not base_failed group by lang, k),
jsc as (select c.doc_id, sqrt(greatest(sum(case when share > 0 then share * log2(2 * share / (share + m)) else 0 end + case when m > 0 then m * log2(2 * m / (share + m)) else 0 end) / 2, 0)) as far from cl c join refc r on r.lang = c.lang and r.k = c.k group by c.doc_id)
select b.doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(jsw.far, 0) <= 0.62 and coalesce(jsc.far, 0) <= 0.22 as kept
from b left join jsw using (doc_id) left join jsc using (doc_id)
"""

#: CRC-32 (reflected polynomial 0xEDB88320) of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::ubigint, [ascii(c)::ubigint for c in string_split(cast(doc_id as varchar), '')]),
  lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)::ubigint[]), lambda x, k: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint)"""

#: Equal stretches of eight words at most pairs of places: every run has one at its period's distance.
SQL["op11_periodic_runs"] = f"""
with d0 as (select doc_id, row_number() over () as r, {WORDS} as w, case when doc_id is not null then {_CRC} end as h from documents),
d1 as (select *, cast(h // 10 as bigint) as g, cast((h // 10) % len(w) as bigint) as a from d0),
d2 as (select *, 1 + (len(w) - a) // (3 + g % 8) as p from d1),
d as (select r, doc_id, case when h % 10 = 0 and len(w) > 0 then w[:a] || [w[1 + a + (i % p)] for i in range(0, len(w) - a)] else w end as w from d2),
k as (select r, i, hash(array_to_string(w[i + 1:i + 8], ' ')) as s, array_to_string(w[i + 1:i + 8], ' ') as t from (select r, w, unnest(range(0, len(w) - 7)) as i from d where len(w) >= 24)),
e as (select a.r, a.i, b.i - a.i as q from k a join k b on a.r = b.r and a.s = b.s and a.t = b.t and a.i < b.i),
f as (select *, i - row_number() over (partition by r, q order by i) as island from e),
m as (select r, min(i) as start, count(*) + 7 + q as length, q from f group by r, q, island having count(*) + 7 + q >= greatest(24, 3 * q)),
u as (select r, start, length, min(q) as period from m group by r, start, length),
x as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from u group by r),
top as (select * from u qualify row_number() over (partition by r order by cast(length as double) / period desc, start, period) = 1),
gone as (select distinct r, unnest(range(start + period, start + length)) as i from u),
left_ as (select t.r, string_agg(t.w[t.i + 1], ' ' order by t.i) as kept from (select r, w, unnest(range(0, len(w))) as i from d) t left join gone on gone.r = t.r and gone.i = t.i where gone.i is null group by t.r)
select d.doc_id, coalesce(x.n_runs, 0) as n_runs, top.start, top.length, top.period, (1000 * top.length) // top.period as exponent_milli,
       sha256(coalesce(x.lines, '')) as runs_sha256, sha256(coalesce(left_.kept, '')) as collapsed_sha256
from d left join x using (r) left join top using (r) left join left_ using (r)
"""

_SHARE = "1 + (1000000000::hugeint * ({n} + 2)) // ({total} + 2 * v)"

SQL["op12_source_divergence"] = f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
k as (select lang, term, count(*) as n from t group by all having count(distinct r) >= 10),
s as (select lang, count(*) as v, sum(n) as total from k group by lang),
c as (select lang, source, term, count(*) as n from t join k using (lang, term) group by all),
g as (select lang, source, coalesce(sum(c.n), 0) as total from (select distinct lang, source from d) left join c using (lang, source) group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, {_SHARE.format(n="coalesce(c.n, 0)", total="g.total")} as p, {_SHARE.format(n="k.n", total="s.total")} as q
  from g join k using (lang) join s using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f.value, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // (p + q) as bigint) as value from p where n > 0 and p > q)
select *, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as int) as rank from (select * from pairs union all select * from terms) qualify part = 'pair' or rank <= 10
"""

SQL["op13_warc_pages"] = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from p),
r as (select *, row_number() over (partition by payload_digest order by page_id) as place, min(page_id) over (partition by payload_digest) as least from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes < 100 or place = 1 or least is null then 'response' else 'revisit' end as record_type,
       case when payload_bytes >= 100 and place > 1 then least end as refers_to
from r
"""
