"""SQL twins of the queries, for an independent engine over the same tables.

Written for an engine whose regular expressions have no look-around: white space is doubled by marks or
captured instead. Small templates stand for what recurs.
"""

from __future__ import annotations

from .functions.strings import INVISIBLE, NL, NS, WS, S, fold_table
from .operators.metadata import LETTER, SMALL, ascii_table

_FROM, _TO = (x.replace("'", "''") for x in fold_table())
_ASCII_FROM, _ASCII_TO, _ASCII_REST = ascii_table()


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{S}+$', '')"


def fold(x: str) -> str:
    return f"replace(replace(lower(translate(regexp_replace({strip(x)}, '\\p{{Mn}}+', '', 'g'), '{_FROM}', '{_TO}')), 'ß', 'ss'), 'ŉ', 'ʼn')"


def split_lines(x: str) -> str:
    return f"(case when {x} = '' then []::varchar[] when {x} is null then null else regexp_split_to_array(regexp_replace({x}, '(?:\\r\\n|[{NL}])$', ''), '\\r\\n|[{NL}]') end)"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def join(x: str) -> str:
    return f"coalesce(array_to_string({x}, chr(10)), '')"


def capped(x: str) -> str:
    """Whether a stripped line is short and mostly capitals."""
    return f"(length({x}) between 4 and 80 and {count(x, chr(92) + 'p{L}')} >= 4 and {count(x, chr(92) + 'p{Lu}')} / nullif({count(x, chr(92) + 'p{L}')}, 0)::double >= 0.6)"


FF = "chr(12)"
NUMBER, EDGE, GARBAGE = r"^\p{Nd}{1,4}$", r"^[^\p{L}\p{N}_À-ÿ]$", rf"^{S}*[—-]*<[-—<>]+"
LEADING, TRAILING = rf"^\p{{Nd}}{{1,4}}{S}+([^\n]+)$", rf"^([^\n]*{NS}){S}+\p{{Nd}}{{1,4}}$"
MARKER = rf"(?m)^{S}*--{S}*\p{{Nd}}+{S}+of{S}+\p{{Nd}}+{S}*--{S}*$"
TOC = rf"(?:[.…]{S}*[.…][.…{WS}]*|,){S}*\p{{Nd}}{{1,4}}{S}*;?{S}*$"
TAIL = rf"^(?:[.…]{{2,}}{S}*|,){S}*\p{{Nd}}{{1,4}}{S}*;?{S}*$"
ENTRY = rf"^[^\n]+?[.…]{{2,}}{S}*\p{{Nd}}{{1,4}}{S}*$"
NUMBERED = rf"^(?:(\p{{Nd}}+(?:\.\p{{Nd}}+){{1,3}}){S}+|(\p{{Nd}}+)\.{S}+)([^\n]+)\n?$"
ROMAN = rf"^IL{S}*[.\-–—]{S}*"

_PAGES = f"select extraction_id, unnest(range(len(string_split(raw_text, {FF}))))::int as page_no, unnest(string_split(raw_text, {FF})) as page from extraction_results where raw_text is not null"
_LINES = f"select extraction_id, page_no, unnest(range(len(ls)))::int as line_no, unnest(ls) as line from (select extraction_id, page_no, {split_lines('page')} as ls from ({_PAGES}))"
_NONBLANK = f"list_filter(list_transform({split_lines('page')}, lambda x: {strip('x')}), lambda x: x <> '')"
_FIRSTS = f"select extraction_id, {fold('ls[1]')} as header from (select extraction_id, {_NONBLANK} as ls from ({_PAGES}) where extraction_id in (select extraction_id from extraction_results where contains(raw_text, {FF})))"
_HEADERS = f"select extraction_id, header, count(*) as n from ({_FIRSTS}) where header <> '' group by all having count(*) >= 2"
_NOISE = f"({count('page', '[|]')} * 3 + {count('page', '[a-zà-ÿ][A-ZÁÀÂÃÉÊÍÓÔÕÚÇ]')} * 2 + {count('page', f'(?m)^{S}*' + chr(92) + 'p{Nd}{1,4}' + f'{S}+[a-zà-ÿ]')} * 4 + {count('page', '[—-]*<[-—<>]+')} * 5)"
_PRINTED = f"select *, case when regexp_matches(last_line, '{NUMBER}') then last_line end as printed from (select *, {_NONBLANK}[-1] as last_line from ({_PAGES}))"
_BEST = f"select extraction_id, printed, arg_min(page_no, row({_NOISE}, -length(page), page_no)) as best, count(*) as copies from ({_PRINTED}) where printed is not null group by all"


def _bare(x: str) -> str:
    cut = f"(case when regexp_matches({x}, '{TRAILING}') then regexp_extract({x}, '{TRAILING}', 1) else {x} end)"
    return f"{fold(f'''(case when regexp_matches({cut}, '{LEADING}') then regexp_extract({cut}, '{LEADING}', 1) else {cut} end)''')}"


def _text(body: str) -> str:
    return f"select extraction_id, {body} as text from extraction_results"


_KEPT = f"list_filter({split_lines('raw_text')}, lambda x: not regexp_matches(x, '{GARBAGE}'))"
_DOCS = "select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents"
_PARAS = f"select doc_id, unnest(range(len(ps)))::int as para_no, unnest(ps) as p from (select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: x <> '') as ps from ({_DOCS}))"
_COLOPHON = "deposito legal|paginacao|impressao|acabamento|design de capa|isbn|copyright|todos os direitos|titulo original"
_NAMED = "('preambulo', 'introducao', 'conclusao', 'epilogo', 'anexo', 'apendice', 'bibliografia', 'agradecimentos', 'nota do autor', 'nota do tradutor')"
_RULES = f"""select doc_id, para_no, p, f, regexp_matches(f, '^(?:sumario|indice|conteudo|table of contents)(?:$| )') as toc_marker, f in {_NAMED} as named, regexp_matches(f, '{_COLOPHON}') as colophon,
regexp_matches(p, '{ENTRY}') as toc_entry, length(p) <= 90 and regexp_matches(p, '{TOC}') as toc_like, regexp_matches(p, '{TAIL}') as toc_tail,
length(p) between 8 and 70 and coalesce({count('p', chr(92) + 'p{Lu}')} / nullif({count('p', chr(92) + 'p{L}')}, 0)::double, 0) >= 0.75 and p not like '%.' and not contains(p, ';') and not regexp_matches(f, '{_COLOPHON}') as capitals,
case when regexp_matches(p, '{NUMBERED}') and length(p) <= 90 and regexp_matches(regexp_extract(p, '{NUMBERED}', 3), '\\p{{L}}') then least(length(regexp_extract(p, '{NUMBERED}', 1)) - length(replace(regexp_extract(p, '{NUMBERED}', 1), '.', '')) + 2, 4) end::int as numbered,
p like '%.' and regexp_matches(p, '{NUMBERED}') as footnote from (select *, {fold('p')} as f from ({_PARAS}))"""
_STATES = f"""select *, coalesce(max(case when toc_marker then para_no end) over w, -1) > coalesce(max(case when not toc_marker and length(p) > 90 and not toc_entry then para_no end) over w, -1) as inside,
case when toc_marker then 1 when length(p) <= 90 and named then 1 when capitals then 1 else numbered end as base from ({_RULES}) window w as (partition by doc_id order by para_no rows between unbounded preceding and 1 preceding)"""
_LEVELS = f"select *, case when toc_marker then 1 when inside and (length(p) <= 90 or toc_entry) then 0 when inside then null else base end as lvl from ({_STATES})"
_TITLED = f"""select *, coalesce(lvl is null and not (inside and (length(p) <= 90 or toc_entry)) and length(p) between 8 and 50 and regexp_matches(p, '^\\p{{Lu}}') and not regexp_matches(p, '[.!?:;,]$') and not regexp_matches(regexp_replace(p, '[¼½¾]', '', 'g'), '[\\p{{Nd}}\\p{{No}}]')
and not colophon and len(list_filter(regexp_split_to_array(p, '{S}+'), lambda x: x <> '')) between 2 and 8 and length(lead(p) over v) >= 120
and (lag(lvl) over v > 0 or (lag(lvl) over v = 0 and length(lag(p) over v) + 2 >= 120) or (lag(lvl) over v is null and (length(lag(p) over v) >= 120 or lag(p) over v like '#%'))), false) as title_case from ({_LEVELS}) window v as (partition by doc_id order by para_no)"""
_BLOCKS = f"""select doc_id, para_no, case when title_case then 'h2' when lvl = 0 then 'toc' when lvl > 0 then 'h' || lvl else 'prose' end as kind, title_case,
(title_case or coalesce(lvl > 0, false)) and regexp_matches(p, '{ROMAN}') as fixed,
case when title_case then '## ' || regexp_replace(p, '{ROMAN}', 'II. — ') when lvl = 0 then '- ' || p when lvl > 0 then repeat('#', lvl) || ' ' || regexp_replace(p, '{ROMAN}', 'II. — ') else p end as rendered from ({_TITLED})"""
_CLEAN = "select distinct cleanup_id, text from cleanup_results"
_CHUNK = """list_reduce(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {'cur': x, 'done': []::varchar[]}), lambda a, b:
case when length(case when a.cur = '' then b.cur else a.cur || chr(10) || chr(10) || b.cur end) <= 2000 then {'cur': case when a.cur = '' then b.cur else a.cur || chr(10) || chr(10) || b.cur end, 'done': a.done}
when length(b.cur) <= 2000 then {'cur': b.cur, 'done': case when a.cur = '' then a.done else list_append(a.done, a.cur) end}
else {'cur': '', 'done': list_concat(case when a.cur = '' then a.done else list_append(a.done, a.cur) end, list_transform(range(0, length(b.cur), 2000), lambda i: substring(b.cur, i::int + 1, 2000)))} end, {'cur': '', 'done': []::varchar[]})"""
_CHUNKS = f"select cleanup_id, text, case when (c).cur = '' then (c).done else list_append((c).done, (c).cur) end as cs from (select cleanup_id, text, {_CHUNK} as c from ({_CLEAN}) where text is not null)"
_CHECKS = f"select c.*, t.text from (select distinct on (check_id) * from local_check_results) c join ({_CLEAN}) t using (cleanup_id) where t.text is not null"
_SORTED = "list_sort(list_transform(coalesce(matches, []), lambda m, i: {'a': m.\"offset\" is null or m.\"length\" is null, 'o': m.\"offset\", 'l': m.\"length\", 'i': i, 'r': m.replacements[1].value, 's': len(m.replacements) > 0}))"
_APPLY = f"""list_reduce(list_transform({_SORTED}, lambda m: {{'cursor': m.o, 'stop': m.o + m.l, 'out': m.r, 'n': (m.s and m.r is not null and not m.a)::int}}), lambda a, b:
case when coalesce(b.n = 1 and b.cursor >= a.cursor and b.stop <= a.stop, false) then {{'cursor': b.stop, 'stop': a.stop, 'out': a.out || substring(text, a.cursor + 1, b.cursor - a.cursor) || b.out, 'n': a.n + 1}} else a end, {{'cursor': 0::bigint, 'stop': length(text)::bigint, 'out': '', 'n': 0}})"""
_AUTHOR = rf"([{LETTER}](?:{S}?[{LETTER}])*){S}*,{S}*([{LETTER}](?:{S}?[{LETTER}])*){S}*,?{S}*\p{{Nd}}{{4}}-\p{{Nd}}{{4}}"
_TITLE = rf"([A-ZÀ-Ÿ][{SMALL}]{{2,}}(?:{S}+[{SMALL}]+)*){S}*:{S}*([{SMALL}{WS}/\-]{{5,}})"
_ISBN13 = rf"(?i)ISBN{S}*978[-{WS}]?([0-9]{{1,5}})[-{WS}]?([0-9]{{1,5}})[-{WS}]?([0-9]{{1,5}})[-{WS}]?([0-9])"
_ISBN10 = rf"(?i)ISBN{S}*[-{WS}]?([0-9]{{1,5}})[-{WS}]?([0-9]{{1,5}})[-{WS}]?([0-9]{{1,5}})[-{WS}]?([0-9])"


def _digits(pattern: str) -> str:
    return " || ".join(f"regexp_extract(text, '{pattern}', {k})" for k in range(1, 5))


def _whole(k: int) -> str:
    return f"regexp_replace({strip(f'''regexp_extract(text, '{_AUTHOR}', {k})''')}, '([\\p{{L}}\\p{{N}}_]){S}+([{SMALL}])', '\\1\\2', 'g')"


def _fields(keep: str, source: str) -> str:
    name = f"{_whole(2)} || ' ' || {_whole(1)}"
    title, rest = strip(f"regexp_extract(text, '{_TITLE}', 1)"), f"substring({strip(f'''regexp_extract(text, '{_TITLE}', 2)''')}, 1, 80)"
    return f"""select {keep}, case when regexp_matches(text, '{_AUTHOR}') and not contains({name}, chr(10)) then {name} end as author,
case when regexp_matches(text, '{_TITLE}') and length({title}) > 3 and not contains(upper({title}), 'ISBN') and not contains(lower({title}), 'copyright') then {title} || ' : ' || {rest} end as title,
case when regexp_matches(text, '{_ISBN13}') and length('978' || {_digits(_ISBN13)}) >= 13 then '978' || {_digits(_ISBN13)} when regexp_matches(text, '{_ISBN10}') and length({_digits(_ISBN10)}) >= 10 then {_digits(_ISBN10)} end as isbn from {source}"""


def _slug(x: str, most: int) -> str:
    ascii_ = f"regexp_replace(translate({x}, '{_ASCII_FROM}', '{_ASCII_TO}'), '[^\\x00-\\x7f]', '', 'g')"
    return f"substring(regexp_replace(regexp_replace(regexp_replace(lower({ascii_}), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 1, {most})"


_STEM = "regexp_replace(regexp_extract(filename, '([^/]*)$', 1), '(.)\\.[^./]*$', '\\1')"
_CARD = _fields("card_id, filename", "(select card_id, filename, coalesce(text, '') as text from catalogue_cards)")
_HYPHEN = "([A-Za-zÀ-ÿ]+)-\\n([a-zà-ÿ])"
_LATEST = "select * from (select *, row_number() over (partition by batch_id, slug order by recorded_at desc nulls last, name desc nulls last, input_pdf desc nulls last, status desc nulls last, attempts desc nulls last, error desc nulls last, output_dir desc nulls last, cleaned_sha256 desc nulls last, lt_local desc nulls last, metadata_source desc nulls last, metadata_confidence desc nulls last) as k from book_records) where k = 1"

SQL: dict[str, str] = {
    "pages": f"select extraction_id, page_no, length(page) as chars, page from ({_PAGES})",
    "lines": f"select extraction_id, page_no, line_no, line, {strip('line')} as stripped from ({_LINES})",
    "leading_pages": f"select extraction_id, count(*) as pages_left from ({_PAGES}) where page_no >= 2 group by 1",
    "sample_pages": "select extraction_id, count(*) as sampled, min(page) as first_page, max(page) as last_page from (select extraction_id, unnest(pages) as page from extraction_results) where page <= 50 group by 1",
    "line_rules": f"select extraction_id, count_if(regexp_matches(s, '{NUMBER}')) as page_numbers, count_if(regexp_matches(s, '{EDGE}')) as edge_garbage, count_if(regexp_matches(line, '{GARBAGE}')) as garbage_lines, count_if(length(s) <= 90 and regexp_matches(s, '{TOC}')) as toc_lines, count_if({capped('s')}) as capitals from (select *, {strip('line')} as s from ({_LINES})) group by 1",
    "trailing_numbers": f"select extraction_id, page_no, line_no, regexp_extract(s, '{TRAILING}', 1) as base from (select *, {strip('line')} as s from ({_LINES})) where regexp_matches(s, '{TRAILING}')",
    "folded_lines": f"select folded, count(*) as n from (select {fold('line')} as folded from ({_LINES})) where folded <> '' group by 1 having count(*) >= 2",
    "running_headers": _HEADERS,
    "edge_headers": f"select extraction_id, header, count(*) as n from (select extraction_id, unnest([{_bare('ls[1]')}, {_bare('ls[-1]')}]) as header from (select extraction_id, {_NONBLANK} as ls from ({_PAGES}) where extraction_id in (select extraction_id from extraction_results where contains(raw_text, {FF}))) where len(ls) > 0) where header <> '' group by all having count(*) >= 2",
    "header_lines": f"select distinct extraction_id, page_no, line_no from (select extraction_id, page_no, line_no, unnest([{fold('s')}, case when regexp_matches(s, '{LEADING}') then {fold(f'''regexp_extract(s, '{LEADING}', 1)''')} end]) as header from (select *, {strip('line')} as s from ({_LINES}))) semi join ({_HEADERS}) using (extraction_id, header)",
    "page_noise": f"select extraction_id, page_no, {_NOISE} as noise, length(page) as chars from ({_PAGES})",
    "best_pages": _BEST,
    "step_quotes": _text("translate(raw_text, '“”‘’', '\"\"''''')"),
    "step_compose": _text("nfc_normalize(raw_text)"),
    "step_page_markers": _text(f"regexp_replace(raw_text, '{MARKER}', '', 'g')"),
    "step_number_lines": _text(join(f"list_filter({split_lines('raw_text')}, lambda x: not regexp_matches({strip('x')}, '{NUMBER}'))").replace("coalesce(", "if(raw_text is null, null, coalesce(", 1) + ")"),
    "step_invisibles": _text(f"regexp_replace(raw_text, '[{INVISIBLE}]', '', 'g')"),
    "step_bars": _text(f"regexp_replace(regexp_replace(regexp_replace(raw_text, '({S})', chr(57344) || '\\1' || chr(57345), 'g'), '(^|' || chr(57345) || ')[|](' || chr(57344) || '|$)', '\\1\\2', 'g'), '[' || chr(57344) || chr(57345) || ']', '', 'g')"),
    "step_sections": _text(f"regexp_replace(raw_text, '([.!?»]){S}+(\\p{{Nd}}{{1,2}}\\.{S}+[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ])', '\\1' || chr(10) || chr(10) || '\\2', 'g')"),
    "step_garbage_lines": _text(f"if(raw_text is null, null, {join(_KEPT)})"),
    "step_inline_numbers": f"select extraction_id, if(raw_text is null, null, {join(f'''list_transform(ls, lambda x, i: case when i > 1 and {rstrip('ls[i - 1]')} like '%-' then regexp_replace(x, '^{S}*' || '[0-9' || chr(92) || 'p{{Nd}}]{{1,4}}{S}+([a-zà-ÿ])', '\\1') else x end)''')}) as text from (select *, {_KEPT} as ls from extraction_results)",
    "step_dehyphenate": _text(f"regexp_replace(raw_text, '{_HYPHEN}', '\\1\\2', 'g')"),
    "step_reflow": _text(f"array_to_string(list_filter(list_transform(string_split(raw_text, chr(10) || chr(10)), lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), ' ')), lambda p: p <> ''), chr(10) || chr(10)) || chr(10)"),
    "step_whitespace": _text(strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_text, '[ \\t]+', ' ', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n[ \\t]+', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')") + " || chr(10)"),
    "step_rstrip_lines": _text(f"if(raw_text is null, null, {join(f'list_transform({split_lines(chr(114) + chr(97) + chr(119) + chr(95) + chr(116) + chr(101) + chr(120) + chr(116))}, lambda x: {rstrip(chr(120))})')})"),
    "cleanup_counts": f"select extraction_id, length(raw_text) as chars_in, {count('raw_text', MARKER)} as page_markers, length(raw_text) - length(regexp_replace(raw_text, '[{INVISIBLE}]', '', 'g')) as invisible, {count('raw_text', _HYPHEN)} as hyphenations, {count('raw_text', chr(92) + 'x{fffd}')} as replacement_chars, len(string_split(raw_text, {FF})) as pages, coalesce({count('raw_text', chr(92) + 'p{Lu}')} / nullif({count('raw_text', chr(92) + 'p{L}')}, 0)::double, 0) as upper_ratio, sha256(raw_text) as raw_sha256 from extraction_results where raw_text is not null",
    "cleanup_totals": "select lower(trim(engine)) as engine, count(*) as texts, " + ", ".join(f"sum(stats.{k}) as {k}" for k in ["chars_in", "chars_out", "page_markers_removed", "headers_removed", "page_numbers_removed", "edge_garbage_removed", "pages_processed", "leading_pages_dropped", "duplicate_pages_removed", "isolated_bars_removed", "embedded_sections_split", "inline_page_numbers_removed", "garbage_lines_removed", "invisible_removed", "hyphenations_joined", "replacement_chars"]) + " from (select distinct on (cleanup_id) * from cleanup_results) join (select extraction_id, engine from extraction_results) using (extraction_id) group by 1",
    "paragraphs": f"select cleanup_id, unnest(range(len(ps)))::int as para_no, unnest(ps) as para from (select cleanup_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: x <> '') as ps from ({_CLEAN}))",
    "paragraph_rules": f"select doc_id, para_no, toc_marker, named, colophon, toc_entry, toc_like, toc_tail, capitals, numbered, footnote from ({_RULES})",
    "structure_blocks": _BLOCKS,
    "structure_stats": f"select d.doc_id, " + ", ".join(f"count_if(kind = '{k}') as {name}" for k, name in (("h1", "h1"), ("h2", "h2"), ("h3", "h3"), ("h4", "h4"), ("toc", "toc_entries"), ("prose", "prose"), ("list", "list_items"))) + f", count_if(coalesce(title_case, false)) as title_case_headings, count_if(coalesce(fixed, false)) as heading_ocr_corrections, sha256(coalesce(string_agg(rendered, chr(10) || chr(10) order by para_no) || chr(10), '')) as sha256 from (select doc_id from documents where text is not null) d left join ({_BLOCKS}) b on d.doc_id = b.doc_id group by 1",
    "review_chunks": f"with recursive c as ({_CHUNKS}), o as (select cleanup_id, text, cs, 1 as k, instr(text, cs[1]) - 1 as pos from c where len(cs) > 0 union all select cleanup_id, text, cs, k + 1, pos + length(cs[k]) + instr(substring(text, pos + length(cs[k]) + 1), cs[k + 1]) - 1 from o where k < len(cs)) select cleanup_id, (k - 1)::int as chunk_no, pos::int as char_offset, cs[k] as chunk from o",
    "review_manifest": f"select cleanup_id, 'pt-BR' as language, sha256(text) as source_sha256, length(text) as char_count, len(cs) as chunk_count, 60000 as char_limit_per_request, list_transform(cs, lambda x: length(x)) as chunk_sizes from ({_CHUNKS})",
    "proposals": f"select check_id, (a).out || substring(text, (a).cursor + 1) as proposal, (a).n as applied from (select check_id, text, {_APPLY} as a from ({_CHECKS}))",
    "imports": f"select check_id, text <> coalesce(corrected_text, text) as changed, case when corrected_text is not null then true end as source_hash_matches, text <> coalesce(corrected_text, text) as has_diff from ({_CHECKS})",
    "match_totals": "select m.message as message, count(*) as n, count_if(coalesce(len(m.replacements) > 0, false)) as with_replacement from (select unnest(matches) as m from (select distinct on (check_id) * from local_check_results)) group by 1",
    "plain_text": "select doc_id, array_to_string(list_transform(regexp_split_to_array(regexp_replace('## ' || replace(text, chr(10), chr(10) || '- '), '\\n$', ''), '\\r?\\n'), lambda x: regexp_replace(regexp_replace(x, '^#+\\s*', ''), '^- ', '— ')), chr(10)) as text from documents where text is not null",
    "card_fields": _fields("card_id", "catalogue_cards where text is not null"),
    "card_metadata": f"select card_id, case when author is not null and isbn is not null then 'ficha_catalografica' else 'filename' end as meta_source, case when isbn is not null then author end as meta_author, case when author is not null and isbn is not null then title end as meta_title, case when author is not null then isbn end as meta_isbn, case when author is not null and isbn is not null then substring(concat_ws('-', {_slug('author', 30)}, {_slug('title', 40)}, substring(isbn, 1, 10)), 1, 80) else {_slug(_STEM, 120)} end as meta_slug, case when author is null or isbn is null then 0.55 when title is not null then 0.85 else 0.73 end::double as meta_confidence from ({_CARD})",
    "page_ranges": "select batch_id, slug, pages.last - pages.first + 1 as taken, case when pages.last > 40 then pages.last else least(pages.last, 50) end as by_default, format('pages-{:03d}-{:03d}', pages.first, pages.last) as folder from (select distinct batch_id, slug, pages from book_records where pages.first >= 1 and pages.last >= pages.first)",
    "ledger_latest": f"select status, count(*) as books, max(recorded_at) as last_at from ({_LATEST}) group by 1",
    "ledger_totals": f"select batch_id, count(*) as total_books, count_if(status in ('success', 'failed')) as processed, count_if(status = 'success') as succeeded, count_if(status = 'failed') as failed, count_if(status = 'skipped') as skipped from ({_LATEST}) group by 1",
    "completed": "select distinct slug from book_records where status = 'success' and slug is not null",
    "to_process": "select card_id, slug from catalogue_cards where slug not in (select slug from book_records where status = 'success' and slug is not null)",
    "to_skip": "select card_id, slug from catalogue_cards where slug in (select slug from book_records where status = 'success' and slug is not null)",
    "slug_collisions": "select slug, count(distinct input_pdf) as inputs from book_records group by 1 having count(distinct input_pdf) > 1",
    "engine_choice": f"select slug, native_chars, case when native_chars >= 200 then 'native' else 'ocr' end as engine from (select slug, coalesce(sum(case when lower(trim(engine)) = 'native' then length({strip('raw_text')}) end), 0) as native_chars from extraction_results where slug is not null group by 1)",
    "arrivals": "select time_bucket(interval 1 day, received_at) as \"from\", engine, count(*) as texts, sum(length(raw_text)) as chars from extraction_results where received_at is not null group by 1, 2",
}
SQL["body_lines"] = f"select extraction_id, count(*) as n from (select extraction_id, page_no, line_no from ({_LINES}) where {strip('line')} <> '') anti join ({SQL['header_lines']}) using (extraction_id, page_no, line_no) group by 1"


def _clean_text(enhanced: bool) -> str:
    """The whole cleanup as a chain of common table expressions over lines.

    Pages that bear the same printed number are compared by a sequence matcher, which SQL lacks; the twin holds where no page of a
    text repeats another's number, as in the test tables.
    """
    lines_of = f"unnest(range(len({split_lines('page')})))::int as line_no, unnest({split_lines('page')}) as line"
    without_number = f"case when regexp_matches(s, '{LEADING}') then {fold(f'''regexp_extract(s, '{LEADING}', 1)''')} end"
    marked = f"regexp_replace(regexp_replace(t5, '({S})', chr(57344) || '\\1' || chr(57345), 'g'), '(^|' || chr(57345) || ')[|](' || chr(57344) || '|$)', '\\1\\2', 'g')"
    section = rf"([.!?»]){S}+(\p{{Nd}}{{1,2}}\.{S}+[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ])"
    parted = f"regexp_replace(t6, '{section}', '\\1' || chr(10) || chr(10) || '\\2', 'g')"
    opened = rf"^{S}*[0-9\p{{Nd}}]{{1,4}}{S}+([a-zà-ÿ])"
    flowing = f"array_to_string(list_filter(list_transform(string_split(t8, chr(10) || chr(10)), lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), ' ')), lambda p: p <> ''), chr(10) || chr(10)) || chr(10)"
    spaced = strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(t9, '[ \\t]+', ' ', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n[ \\t]+', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
    unnumbered = join(f"list_filter(ls, lambda x: not regexp_matches({strip('x')}, '{NUMBER}'))")
    sought, bottom, foot_heads, more_heads, t4, t8 = f"[{fold('s')}, {without_number}]", "n or g", "", "", "t4", "t8_plain"
    if enhanced:
        sought = f"[{fold('s')}, {without_number}, case when regexp_matches(s, '{TRAILING}') then {fold(f"""regexp_extract(s, '{TRAILING}', 1)""")} end]"
        bottom, foot_heads = "n or g or h", " + count_if(foot and h and not n and not g)"
        more_heads = f" union select extraction_id, header from (select extraction_id, unnest([{_bare('ls[1]')}, {_bare('ls[-1]')}]) as header from (select extraction_id, {_NONBLANK} as ls from paged) where len(ls) > 0) where header <> '' group by all having count(*) >= 2"
        t4 = "replace(t4, chr(2) || chr(10), '')"
        t8 = join(f"list_transform({split_lines('t8_plain')}, lambda x: case when length({strip('x')}) <= 90 and regexp_matches({strip('x')}, '{TOC}') then chr(10) || x || chr(10) else x end)")
    lost = count("out", chr(92) + "x{fffd}")
    parts = {
        "s2": "select extraction_id, raw_text, nfc_normalize(" + "translate(raw_text, '“”‘’', '\"\"''''')" + ") as t2 from extraction_results where raw_text is not null",
        "s3": f"select *, regexp_replace(t2, '{MARKER}', '', 'g') as t3, {count('t2', MARKER)} as page_markers_removed from s2",
        "paged": f"select extraction_id, unnest(range(len(string_split(t3, {FF}))))::int as page_no, unnest(string_split(t3, {FF})) as page from s3 where contains(t3, {FF})",
        "heads": f"select extraction_id, header from (select extraction_id, {fold('ls[1]')} as header from (select extraction_id, {_NONBLANK} as ls from paged)) where header <> '' group by all having count(*) >= 2{more_heads}",
        "kept": f"select *, {strip('line')} as s from (select extraction_id, page_no, line_no, {rstrip('line')} as line from (select extraction_id, page_no, {lines_of} from paged)) where not regexp_matches(line, '{GARBAGE}')",
        "likely": f"select extraction_id, page_no, line_no from (select extraction_id, page_no, line_no, unnest({sought}) as header from kept where s <> '') semi join heads using (extraction_id, header)",
        "told": f"select k.*, l.line_no is not null as h, regexp_matches(s, '{NUMBER}') as n, regexp_matches(s, '{EDGE}') as g from kept k left join (select distinct * from likely) l using (extraction_id, page_no, line_no)",
        "following": "select *, lead(h) over (partition by extraction_id, page_no order by line_no) as next_h from told where s <> ''",
        "topped": "select *, sum((not (h or (length(s) <= 3 and coalesce(next_h, false))))::int) over (partition by extraction_id, page_no order by line_no) = 0 as top from following",
        "footed": f"select *, not top and sum((top or not ({bottom}))::int) over (partition by extraction_id, page_no order by line_no desc) = 0 as foot from topped",
        "edges": f"select extraction_id, page_no, min(line_no) filter (not top and not foot) as a, max(line_no) filter (not top and not foot) as b, count_if(top and h){foot_heads} as hs, count_if(foot and n) as ns, count_if(top and not h) + count_if(foot and g and not n) as gs from footed group by all",
        "bodies": f"select t.*, case when t.line_no = e.a then regexp_replace(t.line, '^{S}+', '') else t.line end as x from told t join edges e using (extraction_id, page_no) where t.line_no between e.a and e.b",
        "rest": "select extraction_id, string_agg(x, chr(10) order by page_no, line_no) filter (not h and not n) as t4, count_if(h) as hs, count_if(n and not h) as ns from bodies group by 1",
        "gone": "select extraction_id, sum(hs) as hs, sum(ns) as ns, sum(gs) as gs from edges group by 1",
        "plain": f"select extraction_id, {unnumbered} as t4, len(list_filter(ls, lambda x: regexp_matches({strip('x')}, '{NUMBER}'))) as ns from (select extraction_id, {split_lines('t3')} as ls from s3 where not contains(t3, {FF}))",
        "s4": f"select s3.*, coalesce(r.t4, p.t4, '') as t4, coalesce(g.hs, 0) + coalesce(r.hs, 0) as headers_removed, coalesce(p.ns, coalesce(g.ns, 0) + coalesce(r.ns, 0)) as page_numbers_removed, coalesce(g.gs, 0) as edge_garbage_removed from s3 left join rest r using (extraction_id) left join gone g using (extraction_id) left join plain p using (extraction_id)",
        "s4b": f"select * exclude (t4), {t4} as t4 from s4",
        "s5": f"select *, regexp_replace(t4, '[{INVISIBLE}]', '', 'g') as t5 from s4b",
        "s6": f"select *, regexp_replace({marked}, '[' || chr(57344) || chr(57345) || ']', '', 'g') as t6 from s5",
        "s7": f"select *, {count('t6', section)} as embedded_sections_split, {split_lines(f'({parted})')} as every_line from s6",
        "s7b": f"select *, list_filter(every_line, lambda x: not regexp_matches(x, '{GARBAGE}')) as ls from s7",
        "s7c": f"select *, list_transform(ls, lambda x, i: case when i > 1 and {rstrip('ls[i - 1]')} like '%-' then regexp_replace(x, '{opened}', '\\1') else x end) as shown from s7b",
        "s8": f"select *, {join('shown')} as t7, regexp_replace({join('shown')}, '{_HYPHEN}', '\\1\\2', 'g') as t8_plain from s7c",
        "s8b": f"select *, {t8} as t8 from s8",
        "s9": f"select *, {flowing} as t9 from s8b",
        "s10": f"select *, {spaced} || chr(10) as out from s9",
    }
    chain = ",\n".join(f"{name} as ({body})" for name, body in parts.items())
    stats = f"""length(raw_text) as chars_in, length(out) as chars_out, page_markers_removed, headers_removed, page_numbers_removed, edge_garbage_removed, case when contains(t3, {FF}) then len(string_split(t3, {FF})) else 0 end as pages_processed,
0 as leading_pages_dropped, 0 as duplicate_pages_removed, length(t5) - length(t6) as isolated_bars_removed, embedded_sections_split, len(list_filter(range(1, len(ls) + 1), lambda i: length(ls[i]) > length(shown[i]))) as inline_page_numbers_removed,
len(every_line) - len(ls) as garbage_lines_removed, length(t4) - length(t5) as invisible_removed, {count('t7', _HYPHEN)} as hyphenations_joined, {lost} as replacement_chars"""
    warning = f"case when {lost} > 0 then [{lost} || ' caractere(s) de substituição (' || chr(65533) || ') — revisar OCR'] else []::varchar[] end as warnings"
    return f"with {chain}\nselect extraction_id, out as text, {stats}, {warning} from s10 union all select extraction_id, {', '.join(['null'] * 18)} from extraction_results where raw_text is null"


SQL["clean_text"], SQL["clean_text_enhanced"] = _clean_text(False), _clean_text(True)


def _enhanced_blocks(source: str, key: str) -> str:
    """Enhanced structure of the texts (key, text) of ``source``, a row for each paragraph."""
    bullet = rf"(?s)^[•●▪‣◦*]{S}*({NS}.*)$"
    like = f"(length(p) <= 90 and regexp_matches(p, '{TOC}'))"
    entry = f"(length(p) <= 90 or regexp_matches(p, '{ENTRY}'))"
    deep = f"regexp_extract(p, '{NUMBERED}', 1)"
    by = f"partition by {key} order by para_no"
    parts = {
        "ps": f"select {key}, unnest(range(len(ps)))::int as para_no, unnest(ps) as p from (select {key}, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: x <> '') as ps from ({source}))",
        "takes": f"select *, not {like} and length(p) <= 90 and coalesce(regexp_matches(lead(p) over w, '{TAIL}'), false) as take, lead(p) over w as follower from ps window w as ({by})",
        "merged": f"select {key}, row_number() over (partition by {key} order by para_no) - 1 as para_no, case when take then p || ' ' || follower else p end as p from (select *, coalesce(lag(take) over ({by}), false) as gone from takes) where not gone",
        "folded": f"select *, {fold('p')} as f, {like} as likes, {entry} as entry, case when regexp_matches(p, '{bullet}') then regexp_extract(p, '{bullet}', 1) end as item from merged",
        "facts": f"""select *, regexp_matches(f, '^(?:sumario|indice|conteudo|table of contents)(?:$| )') as marker, case when length(p) <= 90 and f in {_NAMED} then 1
when length(p) between 8 and 70 and coalesce({count('p', chr(92) + 'p{Lu}')} / nullif({count('p', chr(92) + 'p{L}')}, 0)::double, 0) >= 0.75 and p not like '%.' and not contains(p, ';') and not regexp_matches(f, '{_COLOPHON}') then 1
when regexp_matches(p, '{NUMBERED}') and length(p) <= 90 and regexp_matches(regexp_extract(p, '{NUMBERED}', 3), '\\p{{L}}') and p not like '%.' then least(length({deep}) - length(replace({deep}, '.', '')) + 2, 4) end as own,
length(p) between 8 and 50 and regexp_matches(p, '^\\p{{Lu}}') and not regexp_matches(p, '[.!?:;,]$') and not regexp_matches(regexp_replace(p, '[¼½¾]', '', 'g'), '[\\p{{Nd}}\\p{{No}}]') and not regexp_matches(f, '{_COLOPHON}') and len(list_filter(regexp_split_to_array(p, '{S}+'), lambda x: x <> '')) between 2 and 8 as titled,
likes and item is null and coalesce(lead(likes) over ({by}), false) and coalesce(lead(likes, 2) over ({by}), false) as triple from folded""",
        "states": f"select *, coalesce(max(case when marker or (entry and triple) then para_no end) over w, -1) > coalesce(max(case when not marker and not entry then para_no end) over w, -1) as opened from facts window w as ({by} rows between unbounded preceding and 1 preceding)",
        "levels": f"select *, item is not null and not opened as bullet, case when item is not null and not opened then null when marker then 1 when (opened or triple) and entry then 0 when opened or triple then null else own end as lvl, marker or (entry and (triple or opened)) as stays_open from states",
        "around": f"select *, lag(lvl) over w as lvl0, lag(p) over w as p0, lag(case when bullet then item end) over w as item0, lead(p) over w as p1 from levels window w as ({by})",
        "titles": "select *, coalesce(titled and not bullet and lvl is null and not stays_open and length(p1) >= 120 and case when item0 is not null then length(item0) + 2 >= 120 when lvl0 = 0 then length(p0) + 2 >= 120 when lvl0 > 0 then true else length(p0) >= 120 or p0 like '#%' end, false) as title_case from around",
    }
    chain = ", ".join(f"{name} as ({body})" for name, body in parts.items())
    level = "(case when title_case then 2 else lvl end)"
    return f"""with {chain} select {key}, para_no::int as para_no, case when bullet then 'list' when {level} = 0 then 'toc' when {level} > 0 then 'h' || {level} else 'prose' end as kind, title_case, coalesce({level} > 0, false) and regexp_matches(p, '{ROMAN}') as fixed,
case when bullet then '- ' || item when {level} = 0 then '- ' || p when {level} > 0 then repeat('#', {level}::int) || ' ' || regexp_replace(p, '{ROMAN}', 'II. — ') else p end as rendered from titles"""


SQL["structure_blocks_enhanced"] = _enhanced_blocks(_DOCS, "doc_id")


def _clean_and_structure() -> str:
    """Enhanced cleanup, then enhanced structure, with the report as JSON in the order of its fields."""
    cleaned = "select * from clean"
    blocks = _enhanced_blocks("select extraction_id, text from clean where text is not null", "extraction_id")
    stats = ["chars_in", "chars_out", "page_markers_removed", "headers_removed", "page_numbers_removed", "edge_garbage_removed", "pages_processed", "leading_pages_dropped", "duplicate_pages_removed", "isolated_bars_removed", "embedded_sections_split", "inline_page_numbers_removed", "garbage_lines_removed", "invisible_removed", "hyphenations_joined", "replacement_chars"]
    kinds = [("h1", "h1"), ("h2", "h2"), ("h3", "h3"), ("h4", "h4"), ("toc_entries", "toc"), ("prose", "prose"), ("title_case_headings", None), ("heading_ocr_corrections", None), ("list_items", "list")]
    tallies = ", ".join(f"count_if(kind = '{k}') as {name}" if k else f"count_if({'title_case' if name == 'title_case_headings' else 'fixed'}) as {name}" for name, k in kinds)
    cleanup = ", ".join(f"'{k}': c.{k}::bigint" for k in stats)
    structure = ", ".join(f"'{k}': coalesce(s.{k}, 0)::bigint" for k, _ in kinds)
    text = "coalesce(s.text || chr(10), '')"
    return f"""with clean as materialized ({SQL['clean_text_enhanced']}), blocks as ({blocks}), s as (select extraction_id, string_agg(rendered, chr(10) || chr(10) order by para_no) as text, {tallies} from blocks group by 1)
select c.extraction_id, case when c.text is not null then {text} end as text, case when c.text is null then '{{}}' else to_json({{'raw_sha256': sha256(e.raw_text), 'cleaned_sha256': sha256({text}), 'cleanup_stats': {{{cleanup}}}, 'cleanup_warnings': c.warnings, 'structure_stats': {{{structure}}}}})::varchar end as report
from ({cleaned}) c join extraction_results e using (extraction_id) left join s using (extraction_id)"""


SQL["clean_and_structure"] = _clean_and_structure()
_PLAIN_BLOCKS = _BLOCKS.replace(_DOCS, "select extraction_id as doc_id, text from clean where text is not null")
SQL["stream_clean"] = f"""with clean as materialized ({SQL['clean_text']}), blocks as ({_PLAIN_BLOCKS}), s as (select doc_id, string_agg(rendered, chr(10) || chr(10) order by para_no) as text from blocks group by 1)
select c.extraction_id, case when c.text is not null then coalesce(s.text || chr(10), '') end as text from clean c left join s on s.doc_id = c.extraction_id"""
