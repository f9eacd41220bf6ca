"""DuckDB SQL for the text queries that SQL can express on whole tables."""

from __future__ import annotations

from tidemark.llm import chat, decontaminate, importance, phrases, quality, secrets, sharding, urlfilter, warc
from tidemark.llm.shared import SPACE

_WORDS = "list_filter(regexp_split_to_array({}, '" + SPACE + "'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The table of a byte's CRC-32 by its rule, and the CRC-32 of a text from it.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"


def _crc32(text: str, table: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(list_reduce([4294967295::bigint] || {codes}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


def _chat(rule: chat.Windows = chat.Windows()) -> str:
    marks = len(chat.OPEN + chat.MIDDLE + chat.CLOSE)
    plain = "".join(p for p, _ in chat.ESCAPES)
    chars = lambda c: f"(2 * length({c}) - length(translate({c}, {_quoted(plain)}, '')))"
    return f"""
with every as (
  select conv_id, turn, role, text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
clean as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from every),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as n,
    role = {_quoted(rule.system_role)} as sys, len({_WORDS.format("text")}) + {chat.MARK_TOKENS} as tokens,
    {chars("role")} + {chars("text")} + {marks} as chars
  from clean),
sized as (
  select *, case when sys then 0 else tokens end as own,
    greatest(1, {rule.budget - rule.history} - coalesce(sum(case when sys then tokens end) over (partition by conv_id), 0)) as room
  from numbered),
placed as (
  select *, sum(own) over (partition by conv_id order by n) - own as before, own * 2 > room as long,
    case when sys then 0 else (own * 2 > room)::int + coalesce(lag((own * 2 > room)::int) over (partition by conv_id, sys order by n), 0) end as opens
  from sized),
runs as (select *, sum(opens) over (partition by conv_id order by n) as run from placed),
cuts as (
  select *, (before - min(before) over r) // greatest(1, room - max(own) over r) as cut from runs
  window r as (partition by conv_id, sys, run)),
spans as (
  select *, min(n) over (partition by conv_id, sys, run, cut) as first,
    min(case when not sys then n end) over (partition by conv_id order by before range between {rule.history} preceding and current row) as back
  from cuts),
heads as (select conv_id, first, back from spans where not sys and n = first),
windows as (
  select s.conv_id, sum(s.chars) as chars from spans s left join heads h on s.conv_id is not distinct from h.conv_id
  where s.sys or (s.n >= h.back and (s.first = h.first or s.n < h.first)) group by s.conv_id)
select s.conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = {_quoted(rule.target_role)}), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = {_quoted(rule.target_role)}), '')) as loss_sha256,
  any_value(w.chars)::bigint as formatted_chars
from spans s join windows w on s.conv_id is not distinct from w.conv_id group by s.conv_id"""


def _decontaminate(rule: decontaminate.Templates = decontaminate.Templates()) -> str:
    """Templates, windows, shares and slots by lists and joins of texts; lookbehind by a mark before the capital letter.

    Items that are found by their values are searched by plain containment.
    """
    d, k = decontaminate, rule.window
    spaced = lambda t: f"regexp_replace({t}, {_quoted(d.UNSPACED)}, ' \\1 ', 'g')"
    marked = "regexp_replace(t, '([\\p{Ll},;]) (\\p{Lu})', '\\1 ' || chr(4) || '\\2', 'g')"
    named = "replace(regexp_replace(m, chr(4) || '\\p{Lu}\\p{Ll}+', ' ' || chr(3) || ' ', 'g'), chr(4), '')"
    measured = f"regexp_replace({named}, {_quoted(d.UNIT_PATTERN)}, ' ' || chr(1) || ' ' || chr(2) || ' ', 'g')"
    counted = f"regexp_replace({measured}, {_quoted(d.NUMBER_PATTERN)}, ' ' || chr(1) || ' ', 'g')"
    split = lambda t, between: f"list_filter(regexp_split_to_array(lower({t}), {_quoted(between)}), lambda x: x <> '')"
    marks = "(chr(1), chr(2), chr(3))"
    windows = lambda table, ids: f"""
  select {ids}, i - 1 as pos, array_to_string(h[i:i + {k - 1}], ' ') as w from {table}, unnest(range(1, greatest(len(h) - {k - 2}, 1))) as u(i)
  where len(list_filter(h[i:i + {k - 1}], lambda x: x not in {marks})) >= {rule.least_words}"""  # noqa: E731
    filled = lambda table, ids: " union all ".join(
        f"select {ids}, list_filter(range(1, len(h) + 1), lambda i: h[i] = chr({c}))[j] - 1 as pos, {c} as kind, {values}[j] as value "
        f"from {table}, unnest(range(1, len(list_filter(h, lambda x: x = chr({c}))) + 1)) as u(j)"
        for c, values in ((3, "names"), (1, "numbers"), (2, "units"))
    )
    read = lambda ids, source: f"""
  select {ids}, t, {split(counted, d.BETWEEN)} as h, {split("t", d.BETWEEN_PLAIN)} as p, regexp_extract_all(m, chr(4) || '(\\p{{Lu}}\\p{{Ll}}+)', 1) as names,
    regexp_extract_all(t, {_quoted(d.NUMBER_PATTERN)}) as numbers, regexp_extract_all(t, {_quoted(d.UNIT_PATTERN)}, 2) as units
  from (select *, {marked} as m from (select {ids}, {spaced("text")} as t from {source}))"""  # noqa: E731
    shared = lambda met: f"""
  select did, item_id, n_windows, count(distinct w) as n_matched from {met} join sizes using (item_id) group by all
  having count(distinct w) >= {rule.least_share} * n_windows"""  # noqa: E731
    return f"""
with docs as (select row_number() over () as did, * from (select distinct doc_id, text from documents where text is not null)),
d as ({read("did, doc_id", "docs")}),
b as ({read("item_id", "(select distinct item_id, text from benchmark where text is not null)")}),
wanted as (select item_id, w, min(pos) as item_at from ({windows("b", "item_id")}) group by item_id, w),
sizes as (select item_id, count(*) as n_windows from wanted group by item_id),
met as (select did, pos, w, item_id, item_at, pos - item_at as shift from ({windows("d", "did")}) join wanted using (w)),
held as ({shared("met")}),
aligned as (select met.* from met semi join held using (did, item_id)),
of_docs as (select * from ({filled("(select d.* from d semi join held using (did))", "did")}) where pos is not null),
of_items as (select * from ({filled("b", "item_id")}) where pos is not null),
votes as (
  select a.did, a.item_id, a.shift, i.kind, i.value, count(distinct o.value) as n
  from (select distinct did, item_id, shift from aligned) a join of_items i using (item_id) join of_docs o on o.did = a.did and o.pos = i.pos + a.shift and o.kind = i.kind group by all),
bad as (select did, item_id, shift from votes group by all having avg((n = 1)::int) < {rule.least_consistent}),
sure as ({shared("(select * from aligned anti join bad using (did, item_id, shift))")}),
bare as (
  select *, len(list_distinct(list_transform(range(1, len(p) - least({k}, len(p)) + 2), lambda i: array_to_string(p[i:i + least({k}, len(p)) - 1], ' ')))) as n
  from b where len(p) > 0 and item_id not in (select item_id from wanted)),
spelled as (
  select did, item_id, n as n_windows, n as n_matched from d join bare on contains(' ' || array_to_string(d.p, ' ') || ' ', ' ' || array_to_string(bare.p, ' ') || ' '))
select distinct doc_id, item_id, n_windows::bigint as n_windows, n_matched::bigint as n_matched from (select * from sure union all select * from spelled) join docs using (did)"""


def _quality(rules: quality.QualityRules = quality.QualityRules()) -> str:
    return f"""
with texts as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
parts as (
  select rid, doc_id, source, t, {_WORDS.format("t")} as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from texts),
windows as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from parts, unnest(range(1, len(w) - 1)) as u(i)),
repeated as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from windows) where c > 1),
covered as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from repeated) group by rid),
counts as (
  select p.doc_id, p.source, len(w)::bigint as n_words,
    length(regexp_replace(t, '{SPACE}', '', 'g'))::bigint as word_chars,
    (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from parts p left join covered c using (rid)),
judged as (
  select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed from counts),
hosts as (select source, count(*)::double as n, sum(base_failed::int)::double as f from judged group by source),
sums as (select sum(n) as n, sum(f) / sum(n) as mean, sum(f * f / n) as ff, count(*) as hosts from hosts),
spread as (select *, mean * (1 - mean) as s, (ff / n - mean * mean) - mean * (1 - mean) * hosts / n as between_hosts from sums),
prior as (
  select mean, least(greatest(case when between_hosts > 0 then s / between_hosts - 1 else {rules.most_weight} end, {rules.least_weight}), {rules.most_weight}) as weight
  from spread),
rates as (select source, mean, n + weight as w, (f + mean * weight) / (n + weight) as rate from hosts, prior),
lows as (select *, greatest(rate - {rules.deviations} * sqrt(rate * (1 - rate) / (w + 1)), 0) as low from rates),
verdicts as (select source, rate, low * (1 - mean) <= {rules.max_odds_ratio} * mean * (1 - low) as good from lows)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and good as kept, round(rate, 6) as host_rate
from judged j join verdicts v on j.source is not distinct from v.source"""


def _secrets(rule: secrets.Ownership = secrets.Ownership()) -> str:
    found = " union all ".join(
        f"select rid, {k} as kind, regexp_extract_all(t, {_quoted(p)}) as w, regexp_extract_all(t, {_quoted(p)}, {g}) as v, regexp_split_to_array(t, {_quoted(p)}) as gaps from texts"
        for k, (_, p, g, _) in enumerate(secrets.KINDS)
    )
    least = " ".join(f"when {k} then {n}" for k, (_, _, _, n) in enumerate(secrets.KINDS))
    names = " ".join(f"when {k} then {_quoted(n)}" for k, (n, *_) in enumerate(secrets.KINDS))
    spans = f"string_agg(case kind {names} end || ':' || st || ':' || en, ',' order by st, kind)"
    count = ", ".join(f"count(*) filter (kind = {k})::bigint as n_{secrets.KINDS[k][0]}" for k in range(secrets.OPAQUE_AT))
    return f"""
with texts as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
found as ({found}),
placed as (
  select rid, kind, v[i] as v, length(w[i]) as n,
    list_sum(list_transform(gaps[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)::bigint as st
  from found, unnest(range(1, len(w) + 1)) as u(i)),
good as (
  select rid, kind, v, st, st + n as en from placed
  where length(v) >= case kind {least} end
    and (kind < {secrets.OPAQUE_AT} or regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]'))),
spans as (
  select * from good g where kind < {secrets.OPAQUE_AT}
    or not exists (select 1 from good b where b.rid = g.rid and b.kind < {secrets.OPAQUE_AT} and b.st < g.en and g.st < b.en)),
owned as (select v, count(distinct source) + (count(*) filter (source is null) > 0)::int as owners from spans join texts using (rid) group by v),
kept as (select s.*, owners, owners <= {rule.max_owners} as live from spans s join owned using (v) where kind < {secrets.OPAQUE_AT} or owners <= {rule.max_owners}),
base as (select rid, {count}, {spans} as list from kept where kind < {secrets.OPAQUE_AT} group by rid),
every as (select rid, {spans} as list, string_agg(owners, ',' order by st, kind) as owners, count(*) filter (live) as n_live from kept group by rid)
select doc_id, {", ".join(f"coalesce(n_{secrets.KINDS[k][0]}, 0) as n_{secrets.KINDS[k][0]}" for k in range(secrets.OPAQUE_AT))},
  sha256(coalesce(base.list, '')) as base_sha256, coalesce(every.list, '') as spans, coalesce(owners, '') as owners, coalesce(n_live, 0) as n_live
from texts left join base using (rid) left join every using (rid)"""


def _urls(rules=urlfilter.RULES) -> str:
    ordered = sorted(rules, key=lambda r: -len(r[0]))

    def fits(rule: str) -> str:
        name, _, start = rule.partition("/")
        return f"suffix('.' || host, {_quoted('.' + name)}) and prefix(path, {_quoted('/' + start)})"

    found = " ".join(f"when {fits(r)} then {_quoted(r)}" for r, _ in ordered)
    verdict = " ".join(f"when {_quoted(r)} then {_quoted(v)}" for r, v in rules)
    return f"""
with parts as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
ruled as (select *, case {found} end as rule from parts),
voted as (select *, case rule {verdict} end as told from ruled),
blocked as (
  select host from voted where rule is not null group by host having sum(case told when 'block' then 1 else -1 end) > 0)
select page_id, host, path, rule, coalesce(told, case when host in (select host from blocked) then 'block' else 'allow' end) as verdict
from voted"""


def _warc(rules: warc.Rules = warc.Rules()) -> str:
    return f"""
with sized as (
  select page_id, url, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
ranked as (
  select *, case when payload_bytes >= {rules.least_bytes} then max(page_id) over (partition by payload_digest, payload_bytes) end as largest,
    row_number() over (partition by payload_digest, page_id order by url nulls first) as tie
  from sized)
select page_id, payload_bytes, payload_digest,
  case when largest is null or page_id = largest and tie = 1 then 'response' else 'revisit' end as record_type,
  case when not (page_id = largest and tie = 1) then largest end as refers_to
from ranked"""


def _sharding(n: int = 8) -> str:
    return f"""
with crc as (select {_CRC_TABLE} as steps),
keyed as (
  select doc_id, coalesce(text, '') as t, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as h, octet_length(encode(coalesce(text, '')))::bigint + 1 as size from documents),
placed as (
  select *, sum(size) over (order by h, doc_id nulls first, size rows unbounded preceding) - size as before,
    row_number() over (order by h, doc_id nulls first, size) as place, sum(size) over () as total
  from keyed),
sharded as (select *, least({n - 1}, (2 * before + size)::hugeint * {n} // (2 * total))::int as shard from placed)
select doc_id, size, {_crc32("t", "steps")} as text_crc32, '{sharding.LAW}' as law, shard,
  place - min(place) over (partition by shard) as slot, null::int as grown_shard
from sharded, crc"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _phrases(rule: phrases.Rules = phrases.Rules()) -> str:
    """All phrases of all texts, counted one by one."""
    grams = " union all ".join(
        f"select lang, {n} as words, w, i, list_aggregate(w[i:i + {n - 1}], 'string_agg', ' ') as phrase from pieces, unnest(range(1, len(w) - {n - 2})) as u(i)" for n in range(1, rule.longest + 1)
    )
    return f"""
with pieces as (
  select coalesce(lang, 'und') as lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w
  from (select lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
grams as ({grams}),
counts as (select lang, phrase, words, count(*) as f from grams group by all having count(*) >= {rule.support}),
totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
several as (select *, string_split(phrase, ' ') as w from counts where words > 1),
inner_spans as (
  select lang, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') as phrase, max(f) as longer
  from several, unnest(range(2, words)) as a(k), unnest(range(1, words - k + 2)) as b(i) group by all),
kept as (
  select s.* from several s left join inner_spans x using (lang, phrase) where coalesce(100 * longer::hugeint < {rule.subsumed_percent} * f::hugeint, true)),
cuts as (
  select s.lang, s.phrase, s.f as a, k, l.f as l, r.f as r, (2000000 * s.f::hugeint // (l.f + r.f))::bigint as score
  from kept s, unnest(range(1, words)) as u(k)
  join counts l on l.lang = s.lang and l.phrase = list_aggregate(w[1:k], 'string_agg', ' ')
  join counts r on r.lang = s.lang and r.phrase = list_aggregate(w[k + 1:], 'string_agg', ' ')),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from worst join totals using (lang) qualify rank <= {rule.top}"""


def _importance(rule: importance.Rules = importance.Rules()) -> str:
    words = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    features = "w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
with crc as (select {_CRC_TABLE} as steps),
docs as (select row_number() over () as rid, doc_id, w, {features} as f from (select doc_id, {words} as w from documents)),
every as (
  select rid, true as own, unnest(f) as feature from docs
  union all select null, false, unnest({features}) from (select {words} as w from benchmark)),
bucketed as (select feature, {_crc32("feature", "steps")} % {rule.buckets} as bucket from (select distinct feature from every), crc),
counts as (select bucket, count(*) filter (own) as s, count(*) filter (not own) as t from every join bucketed using (feature) group by bucket),
totals as (select coalesce(sum(s), 0)::bigint as ss, coalesce(sum(t), 0)::bigint as tt from counts),
gains as (
  select bucket, floor(1000 * ln((t + 1)::double * (ss + {rule.buckets}) / ((s + 1)::double * (tt + {rule.buckets}))))::bigint as gain from counts, totals),
weights as (
  select rid, floor(sum(gain)::bigint / count(*)::double)::bigint as weight
  from every join bucketed using (feature) join gains using (bucket) where own group by rid),
scored as (
  select doc_id, len(w) as n_words, len(f)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{rule.seed}:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from docs left join weights using (rid)),
ranked as (
  select *, row_number() over (partition by n_words >= {rule.least_words} order by score desc, doc_id) as place,
    count(*) over (partition by n_words >= {rule.least_words}) as able from scored)
select doc_id, n_features, weight, score, case when n_words >= {rule.least_words} and place <= able * {rule.drawn_percent} // 100 then place end as rank from ranked"""


SQL: dict[str, str] = {
    "op2_chat": _chat(), "op4_decontaminate": _decontaminate(), "op5_quality": _quality(), "op7_warc": _warc(), "op8_urls": _urls(), "op10_secrets": _secrets(), "op11_sharding": _sharding(),
    "op12_phrases": _phrases(), "op13_importance": _importance(),
}
