"""The queries of `plans.queries` in SQL for DuckDB, written independently of the operators.

Each string is one statement over the given tables. They are put together from a few common
parts: the romanised view, the usable documents, the word forms and the restored texts.
"""

from __future__ import annotations

from markspark.plans.queries import OVERLAP, ROMANISED, ROMANISED_PLAIN, VALID_EVERY, WINDOW
from markspark.language import ROMANIAN as P

L = r"[\p{L}\p{Nl}\p{No}]"
NOT_L = r"[^\p{L}\p{Nl}\p{No}]"
W = r"[\p{L}\p{N}_]+"
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PUNCT = ".,;:!?\"''()„”«»"
MARKED = P.marked
BARE_LIST = "[" + ",".join(f"'{w}'" for w in P.bare_words) + "]"
MARKED_LIST = "[" + ",".join(f"'{w}'" for w in P.always_marked) + "]"


def fix(x: str) -> str:
    return f"translate({x}, '{P.legacy}', '{P.legacy_fixed}')"


def legacy(x: str) -> str:
    return f"translate({x}, '{P.legacy_fixed}', '{P.legacy}')"


def strip(x: str) -> str:
    return f"translate({x}, '{P.marked}', '{P.marked_base}')"


def label(c: str) -> str:
    return (
        f"case when contains('{P.breve_comma}', {c}) then 1 "
        f"when contains('{P.circumflex}', {c}) then 2 else 0 end"
    )


def count_of(x: str, letters: str) -> str:
    return f"length(regexp_replace({x}, '[^{letters}]', '', 'g'))"


def split_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def ratio(x: str) -> str:
    marked, both = count_of(x, P.marked), count_of(x, P.marked + P.candidates)
    return f"coalesce({marked}::double / nullif({both}, 0)::double, 0::double)"


def every_letter(x: str) -> str:
    return " and ".join(
        f"{count_of(f'lower({x})', m)}::double >= "
        f"{least}::double * {count_of(f'lower({x})', p + m)}::double"
        for p, m, least in P.min_marked
    )


def drops(x: str) -> str:
    tokens = f"regexp_extract_all(lower({x}), '{W}')"
    bare = f"len(list_filter({tokens}, lambda w: list_contains({BARE_LIST}, w)))"
    marked = f"len(list_filter({tokens}, lambda w: list_contains({MARKED_LIST}, w)))"
    return f"({bare})::double > 0.05::double * (({bare}) + ({marked}))::double"


def keep(x: str) -> str:
    return (
        f"(length({x}) >= 200 and {ratio(x)} >= 0.05::double and {every_letter(x)} "
        f"and not ({drops(x)}))"
    )


CRC_TABLE = """crct as (select list_transform(range(0, 256), lambda i:
  list_reduce(list_concat([i::bigint], [0,1,2,3,4,5,6,7]::bigint[]),
              lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) as t)"""


def crc(x: str) -> str:
    return (
        "xor(list_reduce(list_concat([4294967295::bigint], "
        f"list_transform(string_split({x}, ''), lambda ch: ascii(ch)::bigint)), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint)"
    )


def crc_bytes(x: str) -> str:
    """The same for texts beyond ASCII."""
    return (
        "xor(list_reduce(list_concat([4294967295::bigint], "
        f"list_transform(range(0, strlen({x})), lambda i: "
        f"('0x' || substr(hex(encode({x})), (2 * i + 1)::bigint, 2))::bigint)), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint)"
    )


RO = f"ro as (select doc_id::varchar as doc_id, doc_id as ord, lang, source, {ROMANISED} as text from documents)"
CLEAN = f"cl as (select doc_id, ord, lang, source, {fix('nfc_normalize(text)')} as text from ro)"
USABLE = f"""{RO}, {CLEAN}, {CRC_TABLE},
us as (select doc_id, ord, lang, source, text, {crc('doc_id')} % {VALID_EVERY} = 0 as valid
       from cl, crct where {keep('text')})"""

CHARS = f"""ch as (select doc_id, ord, unnest(string_split({strip('text')}, '')) as ch,
  generate_subscripts(string_split(text, ''), 1) as pos from us),
cc as (select ch, count(*) as n, min(ord * 10000000 + pos) as first_seen from ch group by ch)"""


def alphabet(size: int) -> str:
    return f"""ab as (select ch, n, (row_number() over (order by ch) + 1) as char_id
  from (select ch, n from cc order by n desc, first_seen limit {size - 2}))"""


FORMS = f"""tk as (select ord, lower(unnest(regexp_extract_all(text, '{L}+'))) as form,
  generate_subscripts(regexp_extract_all(text, '{L}+'), 1) as pos from us where not valid),
fc as (select {strip('form')} as key, form, count(*) as n, min(ord * 10000000 + pos) as first_seen
  from tk group by form),
dict as (select key, form from (
  select key, form, row_number() over (partition by key order by n desc, first_seen) as r from fc
) where r = 1)"""


def restored(source: str, key: str, name: str = "re", pieces: str = "pc") -> str:
    """CTEs that restore `source(key, text)` with `dict`, as `name(key, restored)`."""
    tokens = f"regexp_extract_all({strip(fix('text'))}, '{L}+|{NOT_L}+')"
    recased = (
        "list_aggregate(list_transform(range(1, length(tok) + 1), lambda i: "
        "case when regexp_full_match(substr(tok, i, 1), '\\p{Lu}') "
        "then upper(substr(form, i, 1)) else substr(form, i, 1) end), 'string_agg', '')"
    )
    return f"""{pieces} as (select {key}, unnest({tokens}) as tok,
  generate_subscripts({tokens}, 1) as pos from {source}),
{name} as (select {key}, string_agg(
    case when form is null or length(form) <> length(tok) then tok
         when tok = lower(tok) then form else {recased} end, '' order by pos) as restored
  from {pieces} left join dict on dict.key = lower(tok) group by {key})"""


RESTORED = f"""{USABLE}, {FORMS}, va as (select * from us where valid),
{restored('va', 'doc_id', 're0')},
re as (select va.doc_id, ord, lang, source, text, restored from va join re0 using (doc_id))"""


def tallies(source: str, by: str, name: str = "ta", condition: str = "true") -> str:
    """Long-form counts `name(by, code, n)` from `source(by, text, restored)`."""
    grouped = f"{by}," if by else ""
    return f"""tl_{name} as (select {grouped} unnest(string_split(text, '')) as r,
  unnest(string_split(restored, '')) as o from {source} where {condition}),
tw_{name} as (select {grouped} unnest({split_ws('text')}) as r, unnest({split_ws('restored')}) as o
  from {source} where {condition}),
{name} as (select {grouped} ({label('r')}) * 3 + ({label('o')}) as code, count(*) as n from tl_{name}
    where contains('{P.candidates}{MARKED}', r) group by all
  union all select {grouped} case when r = o then 10 else 9 end, count(*) from tw_{name} group by all)"""


def _cell(codes: list[int]) -> str:
    inside = ",".join(map(str, codes))
    return f"coalesce(sum(n) filter (code in ({inside})), 0)::double"


def _div(a: str, b: str) -> str:
    return f"round(coalesce({a} / nullif({b}, 0), 0), 9)"


METRICS = {
    "candidate_accuracy": _div(_cell([0, 4, 8]), _cell(list(range(9)))),
    **{
        name: value
        for i, label_name in enumerate(("none", "breve_comma", "circumflex"))
        for name, value in (
            (f"precision_{label_name}", _div(_cell([4 * i]), _cell([i, 3 + i, 6 + i]))),
            (f"recall_{label_name}", _div(_cell([4 * i]), _cell([3 * i, 3 * i + 1, 3 * i + 2]))),
        )
    },
    "word_accuracy": f"round({_cell([10])} / nullif({_cell([9, 10])}, 0), 9)",
}


def metrics(names: list[str] | None = None) -> str:
    return ", ".join(f"{METRICS[n]} as {n}" for n in names or METRICS)


LETTER_METRICS = [m for m in METRICS if m != "word_accuracy"]

# Window starts of the training rows, in the rule's own words: walk on by a stride, stop after
# the first window that is not full.
STRIDE = WINDOW - OVERLAP


def training_windows(source: str) -> str:
    return f"""wt as (select doc_id, valid, text, s as start, (s / {STRIDE})::bigint as win_no,
  least({WINDOW}, length(text) - s) as n
  from (select *, unnest(range(0, length(text), {STRIDE})) as s from {source})
  where s = 0 or s - {STRIDE} + {WINDOW} <= length(text))"""


SPLIT = "case when valid then 'valid' else 'train' end as split"

# Contexts of all candidate letters: six characters on either side, edges filled.
EDGE = "chr(2)||chr(2)||chr(2)||chr(2)||chr(2)||chr(2)"


def contexts(source: str, name: str, condition: str) -> str:
    return f"""{name}_a as (select doc_id, lang, string_split(text, '') as orig,
  string_split({strip('text')}, '') as bare,
  string_split({EDGE} || lower({strip('text')}) || {EDGE}, '') as ctx
  from {source} where {condition}),
{name} as (select doc_id, lang, i - 1 as pos, orig[i] as o, bare[i] as letter,
  array_to_string(ctx[i:i+12], '') as c6 from (
    select *, unnest(range(1, len(orig) + 1)) as i from {name}_a)
  where contains('{P.candidates}', letter)),
{name}_l as (select *, {label('o')} as label, c6[3:11] as c4, c6[5:9] as c2, c6[7:7] as c0
  from {name})"""


CONTEXT_MODEL = f"""{contexts('us', 'cx', 'not valid')},
model as (select k, ctx, count(*) filter (label = 0) as n0, count(*) filter (label = 1) as n1,
    count(*) filter (label = 2) as n2
  from (select label, unnest([6, 4, 2, 0]) as k, unnest([c6, c4, c2, c0]) as ctx from cx_l)
  group by k, ctx having count(*) >= 2)"""

SCORED = """hit as (select v.doc_id, v.lang, v.pos, v.letter, v.label,
  coalesce(m6.n0, m4.n0, m2.n0, m0.n0, 0) as n0, coalesce(m6.n1, m4.n1, m2.n1, m0.n1, 0) as n1,
  coalesce(m6.n2, m4.n2, m2.n2, m0.n2, 0) as n2
  from vx_l v left join model m6 on m6.k = 6 and m6.ctx = c6
  left join model m4 on m4.k = 4 and m4.ctx = c4 left join model m2 on m2.k = 2 and m2.ctx = c2
  left join model m0 on m0.k = 0 and m0.ctx = c0),
sc as (select *, case when n0 >= n1 and n0 >= n2 then 0 when n1 >= n2 then 1 else 2 end as pred,
  coalesce(greatest(n0, n1, n2)::double / nullif(n0 + n1 + n2, 0), 0) as confidence from hit)"""
CONTEXT_SCORED = f"{USABLE}, {CONTEXT_MODEL}, {contexts('us', 'vx', 'valid')}, {SCORED}"


def marked_letter(c: str, lab: str) -> str:
    return (
        f"case when {lab} = 1 then translate({c}, '{P.breve_comma_base}', '{P.breve_comma}') "
        f"when {lab} = 2 then translate({c}, '{P.circumflex_base}', '{P.circumflex}') else {c} end"
    )


def per_document(expression: str, name: str) -> str:
    return f"with {RO} select doc_id, {expression} as {name} from ro"


def documents_with_split(name: str = "sp") -> str:
    return f"{name} as (select *, {SPLIT} from us)"


ORACLES: dict[str, str] = {
    "src_parquet": """select doc_id::varchar as doc_id, doc_id as ord, length(text) as n_chars,
        md5(text) as h from documents""",
    "src_hash_sample": f"""with {CRC_TABLE} select doc_id::varchar as doc_id, md5(text) as h
        from documents, crct where {crc('doc_id::varchar')} % 4 = 0""",
    "src_line_chunks": f"""with {CRC_TABLE}, li as (select row_number() over (order by doc_id) - 1
        as line_no, regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '') as line
        from documents),
      g as (select line_no // 50 as ord, string_agg(line, chr(10) order by line_no) as text
        from li group by 1 having count(*) = 50)
      select 'subtitles:' || ord as doc_id, ord, length(text) as n, md5(text) as h from g, crct
      where {crc("('subtitles:' || ord)")} % 2 = 0""",
    "src_line_files": f"""with li as (select row_number() over (order by doc_id) - 1 as line_no,
        regexp_replace(regexp_replace(translate(text, chr(13) || chr(10), '  '), '^{WS}+', ''),
          '{WS}+$', '') as line from documents),
      g as (select line_no // 50 as ord, string_agg(line, chr(10) order by line_no) as text
        from li group by 1 having count(*) = 50)
      select 'subtitles:' || ord as doc_id, ord, length(text) as n, md5(text) as h from g""",
    "src_text_files": """select 'page ' || page_id || '.v1' as doc_id, md5(html) as h,
        row_number() over (order by '/pages/page ' || page_id || '.v1.txt') - 1 as ord from pages""",
    "src_corrections": f"""with {RO}, li as (select doc_id,
        unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) as l,
        generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) as no
        from ro),
      tr as (select doc_id, no, regexp_replace(regexp_replace(l, '^{WS}+', ''), '{WS}+$', '') as l
        from li)
      select doc_id || ':' || no as doc_id, md5({fix('nfc_normalize(l)')}) as h from tr
      where l <> '' and not starts_with(l, '#')""",
    "src_chain": """
      select doc_id::varchar as doc_id, 0::bigint as source_rank, doc_id as ord, md5(text) as h
      from documents
      union all select conv_id || ':' || turn, 1, conv_id * 2147483648 + turn, md5(text)
      from conversations
      union all select item_id::varchar, 2, item_id, md5(text) from benchmark""",
    "src_lines": f"""with {USABLE}, {FORMS}, li as (select ro.doc_id || ':' || (no - 1) as id, l as text
        from (select doc_id, unnest(string_split(text, chr(10))) as l,
              generate_subscripts(string_split(text, chr(10)), 1) as no from ro) ro),
      {restored('li', 'id')}
      select li.id as doc_id, coalesce(restored, '') as restored from li left join re using (id)""",
    "sink_windows": f"""with {USABLE}, {training_windows('us')}
      select {SPLIT}, count(*) as rows, {WINDOW}::bigint as "window" from wt group by valid""",
    "src_windows": f"""with {USABLE}, {training_windows('us')}
      select doc_id, count(*) as rows, sum(n)::bigint as chars, 0::bigint as missing
      from wt where valid group by doc_id""",
    "sink_alphabet": f"with {USABLE}, {CHARS}, {alphabet(40)} select ch, char_id from ab",
    "sink_summary": f"with {RESTORED}, {tallies('re', '')} select {metrics()} from ta",
    "materialize_stamped": f"""with {USABLE}, {training_windows('us')}
      select {SPLIT}, count(*) as rows, true as first_built, false as second_built
      from wt group by valid""",
    # --- text functions ---
    "fix_cedilla": per_document(fix(legacy("text")), "text"),
    "strip_marks": per_document(strip(fix(legacy("text"))), "text"),
    "clean_text": per_document(
        fix(f"nfc_normalize(replace({legacy('text')}, 'ă', 'a' || chr(774)))"), "text"
    ),
    "is_candidate": per_document(count_of(strip("text"), P.candidates), "candidates"),
    "labels_of": per_document(
        f"array_to_string(list_transform(string_split({fix(legacy('text'))}, ''), "
        f"lambda c: {label('c')}), '')",
        "labels",
    ),
    "lower_upper": per_document("lower(text) || '|' || upper(replace(text, 'ß', 'ss'))", "text"),
    "tokenize_w": f"""with {RO} select word, count(*) as n from
        (select unnest(regexp_extract_all(lower(text), '{W}')) as word from ro) group by word""",
    "tokenize_letters": f"""with {RO} select word, count(*) as n from
        (select unnest(regexp_extract_all(text, '{L}+')) as word from ro) group by word""",
    "split_ws": per_document(f"array_to_string({split_ws('text')}, '|')", "words"),
    "strip_ws": per_document(
        f"regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '')", "text"
    ),
    "strip_punct": per_document(
        f"array_to_string(list_transform({split_ws('text')}, lambda w: trim(w, '{PUNCT}')), ' ')",
        "words",
    ),
    "case_transfer": per_document(
        "array_to_string(list_transform(list_zip(string_split(" + strip("text") + ", ''), "
        "string_split(lower(text), '')), lambda p: case when regexp_full_match(p[1], '\\p{Lu}') "
        "then upper(p[2]) else p[2] end), '')",
        "text",
    ),
    "merge_keep_marked": per_document(
        f"array_to_string(list_transform(list_zip(string_split({legacy('text')}, ''), "
        f"string_split(translate({strip('text')}, 'at', 'ăț'), '')), lambda p: case when "
        f"contains('{P.marked}{P.legacy}', p[1]) then {fix('p[1]')} else p[2] end), '')",
        "text",
    ),
    "encode_chars": f"""with {USABLE}, {CHARS}, {alphabet(40)}
      select doc_id, string_agg(coalesce(char_id, 1), ',' order by pos) as ids
      from ch left join ab using (ch) group by doc_id""",
    "encode_example": f"""with {USABLE}, {CHARS}, {alphabet(256)},
      ids as (select doc_id, string_agg(coalesce(char_id, 1), ',' order by pos) as input_ids,
        string_agg(contains('{P.candidates}', ch)::int, '' order by pos) as candidates
        from ch left join ab using (ch) group by doc_id)
      select doc_id, input_ids, candidates, array_to_string(list_transform(string_split(text, ''),
        lambda c: {label('c')}), '') as labels from us join ids using (doc_id)""",
    "decode_restore": f"""with {RO}, c as (select doc_id, unnest(string_split(text, '')) as o,
        generate_subscripts(string_split(text, ''), 1) - 1 as i from ro)
      select doc_id, string_agg(case when (i * 7) % 10 >= 5 then o else {strip('o')} end, ''
        order by i) as restored from c group by doc_id""",
    "skip_no_candidates": f"""with {USABLE}, {FORMS}, wd as (select distinct
        unnest(regexp_extract_all(text, '{L}+')) as text from ro), {restored('wd', 'text')}
      select text, regexp_matches(text, '[{P.candidates}]') as scored,
        case when regexp_matches(text, '[{P.candidates}]') then restored else text end as restored
      from re""",
    "diff_chars": f"""with {RO}, c as (select doc_id, unnest(string_split(text, '')) as to_ch,
        generate_subscripts(string_split(text, ''), 1) - 1 as pos from ro)
      select doc_id, pos, {strip('to_ch')} as from_ch, to_ch from c where {strip('to_ch')} <> to_ch""",
    "count_changed": f"""with {RESTORED}, c as (select doc_id, unnest(string_split(text, '')) as a,
        unnest(string_split(restored, '')) as b from re)
      select doc_id, count(*) filter (a <> b) as changed from c group by doc_id""",
    "split_long_text": f"""with recursive {RO}, cut as (
        select doc_id, 0::bigint as no, 0::bigint as start, null::varchar as piece, text as rest
        from ro
        union all
        select doc_id, no + 1, start + coalesce(length(piece), 0),
          substr(rest, 1, size) , substr(rest, size + 1)
        from (select *, case when length(rest) <= 2000 then length(rest)
            when 2001 - instr(reverse(substr(rest, 1, 2001)), chr(10)) >= 1000
              and contains(substr(rest, 1, 2001), chr(10))
              then 2001 - instr(reverse(substr(rest, 1, 2001)), chr(10))
            when 2001 - instr(reverse(substr(rest, 1, 2001)), ' ') >= 1000
              and contains(substr(rest, 1, 2001), ' ')
              then 2001 - instr(reverse(substr(rest, 1, 2001)), ' ')
            else 2000 end as size
          from cut where no = 0 or rest <> ''))
      select doc_id, no - 1 as no, start, piece from cut where no > 0""",
    "max_chars_guard": per_document("length(text) <= 20000", "accepted"),
    "restore_grouped": f"""with {USABLE}, {FORMS},
      turns as (select conv_id, turn, {ROMANISED_PLAIN} as text from conversations),
      gr as (select conv_id, string_agg(text, chr(10) order by turn) as text from turns group by 1),
      {restored('gr', 'conv_id')},
      pl as (select *, coalesce(sum(length(text) + 1) over (partition by conv_id order by turn
        rows between unbounded preceding and 1 preceding), 0)::bigint as skip from turns)
      select conv_id, turn, substr(restored, skip + 1, length(text)) as restored
      from pl join re using (conv_id)""",
    "restore_grouped_context": f"""with {USABLE}, {CONTEXT_MODEL},
      turns as (select conv_id, turn, {ROMANISED_PLAIN} as text from conversations),
      gr as (select conv_id as doc_id, '' as lang, string_agg(text, chr(10) order by turn) as text
        from turns group by 1),
      {contexts('gr', 'vx', 'true')}, {SCORED},
      le as (select doc_id, unnest(string_split({strip('text')}, '')) as c,
        generate_subscripts(string_split(text, ''), 1) - 1 as pos from gr),
      re as (select doc_id as conv_id, string_agg(case when confidence >= 0.6::double
          then {marked_letter('c', 'pred')} else c end, '' order by pos) as restored
        from le left join (select doc_id, pos, pred, confidence from sc) s using (doc_id, pos)
        group by doc_id),
      pl as (select *, coalesce(sum(length(text) + 1) over (partition by conv_id order by turn
        rows between unbounded preceding and 1 preceding), 0)::bigint as skip from turns)
      select conv_id, turn, substr(restored, skip + 1, length(text)) as restored
      from pl join re using (conv_id)""",
    # --- filters ---
    "diacritic_ratio": per_document(f"round({ratio('text')}, 9)", "ratio"),
    "marks_every_letter": per_document(f"({every_letter('text')})", "passes"),
    "drops_marks": per_document(f"({drops('text')})", "drops"),
    "keep_document": per_document(keep("text"), "keep"),
    "is_validation": f"""with {CRC_TABLE} select doc_id::varchar as doc_id,
        {crc('doc_id::varchar')} % {VALID_EVERY} = 0 as valid from documents, crct""",
    "filtered": f"""with {USABLE} select doc_id, ord, md5(text) as h from us
        order by ord limit 100""",
    "usable": f"with {USABLE} select doc_id, lang, {SPLIT}, md5(text) as h from us",
    # --- joins ---
    "join_dictionary": f"""with {USABLE}, {FORMS}, w as (select lower(unnest(regexp_extract_all(
        {strip('text')}, '{L}+'))) as key from us where valid)
      select key, count(*) as n, any_value(form) as form from w left join dict using (key)
      group by key""",
    "join_alphabet": f"""with {USABLE}, {CHARS}, {alphabet(40)},
      al as (select unnest(string_split({strip('text')}, '')) as ch from ro)
      select ch, count(*) as n, coalesce(any_value(char_id), 1) as char_id
      from al left join ab using (ch) group by ch""",
    "semi_always_marked": f"""with {RO}, w as (select lang,
        unnest(regexp_extract_all(lower(text), '{W}')) as word from ro)
      select lang, word, list_contains({BARE_LIST}, word) as bare,
        list_contains({MARKED_LIST}, word) as marked, count(*) as n from w
      where list_contains({BARE_LIST}, word) or list_contains({MARKED_LIST}, word) group by all""",
    "zip_positional": f"""with {RESTORED}, w as (select unnest({split_ws('text')}) as want,
        unnest({split_ws('restored')}) as got from re) select want, got, count(*) as n from w
      group by want, got""",
    "join_class_names": f"""with {RO}, names(label, name) as (values (0, 'none'),
        (1, 'breve_comma'), (2, 'circumflex')),
      c as (select {label('ch')} as label from (select unnest(string_split(text, '')) as ch from ro))
      select label::bigint as label, name, count(*) as n from c join names using (label)
      group by all""",
    "cross_repeat": """select item_id, copy, md5(text) as h from benchmark, range(90) t(copy)""",
    "corrections_mix": f"""with {USABLE} select doc_id, 1::bigint as copies, length(text) as chars
        from us union all
        select 'known:' || item_id, 90, 90 * length(text) from benchmark""",
    # --- aggregations ---
    "char_counts": f"with {USABLE}, {CHARS} select ch, n from cc",
    "alphabet_build": f"with {USABLE}, {CHARS}, {alphabet(40)} select ch, char_id, n from ab",
    "form_counts": f"with {USABLE}, {FORMS} select key, form, n from fc",
    "fit_dictionary": f"with {USABLE}, {FORMS} select key, form from dict",
    "dictionary_size": f"with {USABLE}, {FORMS} select count(*) as size from dict",
    "confusion": f"""with {RESTORED}, {tallies('re', 'lang')},
      cells as (select distinct lang, t, p from ta, range(3) a(t), range(3) b(p))
      select lang, t as true, p as pred, coalesce(sum(n), 0)::bigint as n from cells
      left join (select lang as l, code, n from ta) x on l = lang and code = t * 3 + p
      group by lang, t, p""",
    "word_accuracy": f"""with {RESTORED}, {tallies('re', 'source')}
      select source, {metrics(['word_accuracy'])} from ta group by source""",
    "precision_recall": f"""with {RESTORED}, {tallies('re', 'source')}
      select source, {metrics([m for m in METRICS if m.startswith(('pre', 'rec'))])}
      from ta group by source""",
    "candidate_accuracy": f"""with {RESTORED}, {tallies('re', 'source')}
      select source, {metrics(['candidate_accuracy'])} from ta group by source""",
    "metrics_summary": f"""with {RESTORED}, {tallies('re', 'lang')}
      select lang, {metrics()} from ta group by lang union all select 'all', {metrics()} from ta""",
    "eval_sample": f"""with {RESTORED}, fs as (select * from re order by ord limit 40),
      {tallies('fs', '')} select {metrics()} from ta""",
    "still_wrong": f"""with {RESTORED}, m as (select doc_id, list_filter(list_zip(
        {split_ws('text')}, {split_ws('restored')}), lambda p: p[1] <> p[2]) as misses
        from re where text <> restored)
      select doc_id,
        array_to_string(list_transform(misses, lambda p: trim(p[2], '{PUNCT}')), ' ') as wrote,
        array_to_string(list_transform(misses, lambda p: trim(p[1], '{PUNCT}')), ' ') as want
      from m""",
    "corrections_summary": f"""with {RESTORED}, {tallies('re', '')}
      select (select count(*) from re) as sentences,
        (select count(*) from re where text <> restored) as still_wrong, {metrics()} from ta""",
    "split_counts": f"""with {USABLE}, {training_windows('us')}
      select {SPLIT}, count(*) as rows, {WINDOW}::bigint as "window" from wt group by valid""",
    "corrections_accuracy": f"""with {USABLE}, {FORMS}, {restored('us', 'doc_id', 're0')},
      re as (select {SPLIT}, text, restored from us join re0 using (doc_id)),
      {tallies('re', 'split')}
      select split, {metrics(['candidate_accuracy'])} from ta group by split""",
    "best_on_validation": f"""with {RESTORED}, st as (select text, {strip('text')} as restored from re),
      {tallies('re', '', 'tf')}, {tallies('st', '', 'ti')},
      e as (select 'identity' as model_id, 1 as step, {metrics(['candidate_accuracy'])} from ti
        union all select 'frequent', 2, {metrics(['candidate_accuracy'])} from tf)
      select model_id, candidate_accuracy from e order by candidate_accuracy desc, step limit 1""",
    # --- windows ---
    "windows_train": f"""with {USABLE}, {CHARS}, {alphabet(256)}, {training_windows('us')},
      en as (select doc_id, list(coalesce(char_id, 1) order by pos) as ids from ch
        left join ab using (ch) group by doc_id),
      la as (select doc_id, list_transform(string_split(text, ''), lambda c: {label('c')}) as labels
        from us)
      select doc_id, win_no, start, n, {SPLIT},
        array_to_string(list_resize(ids[start + 1:start + n], {WINDOW}, 0), ',') as input_ids,
        array_to_string(list_resize(labels[start + 1:start + n], {WINDOW}, 0), '') as labels
      from wt join en using (doc_id) join la using (doc_id)""",
    "windows_plan": f"""with {RO}, s as (select doc_id, text, length(text) as len,
        unnest(case when length(text) <= {WINDOW} then [0] else
          list_concat(range(0, length(text) - {WINDOW}, {STRIDE}), [length(text) - {WINDOW}]) end)
          as start from ro),
      o as (select *, row_number() over (partition by doc_id order by start) - 1 as win_no,
        lead(start) over (partition by doc_id order by start) as following from s)
      select doc_id, win_no, start, least(start + {WINDOW}, len) as end,
        case when win_no = 0 then 0 else start + {OVERLAP // 2} end as keep_from,
        coalesce(following + {OVERLAP // 2}, len) as keep_to,
        substr(text, start + 1, {WINDOW}) as piece from o""",
    "window_stitch": per_document("text", "text"),
    # --- models ---
    "restore_frequent": f"with {RESTORED} select doc_id, lang, text, restored from re",
    "identity": f"""with {USABLE}, st as (select lang, text, {strip('text')} as restored from us
        where valid), {tallies('st', 'lang')} select lang, {metrics()} from ta group by lang""",
    "train_context": f"with {USABLE}, {CONTEXT_MODEL} select k::bigint as k, ctx, n0, n1, n2 from model",
    "restore_frequent_large": f"with {RESTORED} select doc_id, lang, text, restored from re",
    "restore_context": f"""with {CONTEXT_SCORED}, va as (select doc_id, unnest(string_split(
        {strip('text')}, '')) as c, generate_subscripts(string_split(text, ''), 1) - 1 as pos
        from us where valid)
      select doc_id, string_agg(case when confidence >= 0.6::double
        then {marked_letter('c', 'pred')} else c end, '' order by pos) as restored
      from va left join (select doc_id, pos, pred, confidence from sc) s using (doc_id, pos)
      group by doc_id""",
    "candidate_log_loss": f"""with {CONTEXT_SCORED}, p as (select lang, (case label when 0 then n0
        when 1 then n1 else n2 end + 1)::double / (n0 + n1 + n2 + 3)::double as p_true from sc)
      select lang, round(avg(-ln(p_true)), 6) as log_loss from p group by lang""",
    "threshold_sweep": f"""with {CONTEXT_SCORED}, th as (select (i::double / 10) as threshold
        from range(11) r(i)),
      ta as (select round(threshold, 9) as threshold, label * 3 + case when confidence >= threshold
          and {marked_letter('letter', 'pred')} <> letter then pred else 0 end as code,
          count(*) as n from sc, th group by all)
      select threshold, {metrics(LETTER_METRICS)} from ta group by threshold""",
    "choose_threshold": f"""with {CONTEXT_SCORED},
      co as (select lang, confidence, count(*) as n, count(*) filter (pred = label) as hits
        from sc where {marked_letter('letter', 'pred')} <> letter group by all),
      cu as (select lang, confidence,
          sum(n) over (partition by lang order by confidence desc)::bigint as placed,
          sum(hits) over (partition by lang order by confidence desc)::bigint as correct from co),
      lo as (select *, correct::double / placed as p, 1.6448536269514722::double as z from cu),
      bo as (select lang, confidence, placed, correct, (p + z * z / (2.0::double * placed)
          - sqrt(p * (1 - p) / placed + z * z / (4.0::double * placed * placed)) * z)
          / (1 + z * z / placed) as lower from lo),
      be as (select lang, min(confidence) as confidence from bo where lower >= 0.6::double group by lang),
      ma as (select lang, count(*) filter (label <> 0) as marked from sc group by lang)
      select lang, round(be.confidence, 9) as threshold, placed, correct, round(lower, 9) as lower, marked
      from ma left join be using (lang) left join bo using (lang, confidence)""",
    "count_letter_classifier": f"""with {USABLE}, {contexts('us', 'cx', 'not valid')},
      {contexts('us', 'vx', 'valid')},
      fe(name, lo, n) as (values ('f_self', 7, 1), ('f_l1', 6, 2), ('f_r1', 7, 2), ('f_l2', 5, 3),
        ('f_r2', 7, 3), ('f_l3', 4, 4), ('f_r3', 7, 4), ('f_c1', 6, 3), ('f_c2', 5, 5), ('f_c3', 4, 7)),
      vo as (select distinct name || '=' || substr(c6, lo, n) as f from
        (select c6 from cx_l union select c6 from vx_l), fe),
      bu as (select f, {crc_bytes('f')} % 262144 as bucket from vo, crct),
      co as (select bucket, count(*) filter (label = 0) as n0, count(*) filter (label = 1) as n1,
          count(*) filter (label = 2) as n2
        from cx_l, fe, bu where f = name || '=' || substr(c6, lo, n) group by bucket),
      tt as (select count(*) filter (label = 0) as t0, count(*) filter (label = 1) as t1,
        count(*) filter (label = 2) as t2 from cx_l),
      lg as (select bucket, ln((n0 + 1) / (t0 * 10 + 262144)) as l0,
          ln((n1 + 1) / (t1 * 10 + 262144)) as l1, ln((n2 + 1) / (t2 * 10 + 262144)) as l2
        from (select * from co union all select -1, 0, 0, 0), tt),
      un as (select l1 - l0 as u1, l2 - l0 as u2 from lg where bucket = -1),
      su as (select c6, ln((t1 + 1) / (t0 + 1)) + 0.5::double * sum(coalesce(l1 - l0, u1)) as s1,
          ln((t2 + 1) / (t0 + 1)) + 0.5::double * sum(coalesce(l2 - l0, u2)) as s2
        from (select distinct c6 from vx_l) x cross join fe
          join bu on f = name || '=' || substr(c6, lo, n) left join lg using (bucket), un, tt
        group by c6, t0, t1, t2),
      an as (select c6, case when 0 >= s1 and 0 >= s2 then 0 when s1 >= s2 then 1 else 2 end as pred,
          1 / (exp(-greatest(0, s1, s2)) + exp(s1 - greatest(0, s1, s2))
            + exp(s2 - greatest(0, s1, s2))) as confidence from su)
      select lang, label::bigint as label, pred::bigint as pred, count(*) as n,
        round(avg(confidence), 6) as confidence
      from vx_l join an using (c6) group by all""",
    "score_windows": f"""with {RO}, c as (select doc_id, {strip('text')} as t,
        unnest(string_split({strip('text')}, '')) as c,
        unnest(list_concat(['x'], string_split({strip('text')}, '')[1:-2])) as before,
        unnest(list_concat(string_split({strip('text')}, '')[2:], ['x'])) as after,
        generate_subscripts(string_split(text, ''), 1) as pos from ro)
      select doc_id, string_agg(case when before = ' ' then {marked_letter('c', '2')}
        when after = ' ' then {marked_letter('c', '1')} else c end, '' order by pos) as restored
      from c group by doc_id""",
    "vector_quantize": """with v as (select vec_id, list_transform(embedding, lambda x: x::double)
        as e from embeddings),
      g as (select vec_id, unnest([e[i:i+31] for i in range(1, len(e), 32)]) as w from v),
      s as (select vec_id, w, greatest(list_max(list_transform(w, lambda x: abs(x))) / 7,
        1e-8::double) as scale from g),
      q as (select vec_id, scale, list_transform(w, lambda x: (greatest(-7, least(7,
        round_even(x / scale, 0))) + 8)::int) as c from s)
      select vec_id, round(scale, 12) as scale, array_to_string(c, ',') as codes,
        array_to_string([c[i] + 16 * c[i + 1] for i in range(1, len(c), 2)], ',') as packed
      from q""",
    "stored_vector": """with g as (select vec_id, embedding,
        unnest(range(0, len(embedding) // 32)) as k from embeddings),
      w as (select vec_id, k, list_transform(embedding[32 * k + 1:32 * k + 32],
        lambda x: x::double) as w from g),
      s as (select *, greatest(list_max(list_transform(w, lambda x: abs(x))) / 7,
        1e-8::double)::float::double as top from w),
      e as (select *, greatest(floor(log2(top)) - (pow(2, floor(log2(top))) > top)::int
        + (pow(2, floor(log2(top)) + 1) <= top)::int, -14) as e from s),
      h as (select *, round_even(top / pow(2, e - 10), 0) as steps from e),
      q as (select vec_id, k, w, ((e + 14) * 1024 + steps)::int as bits,
        steps * pow(2, e - 10) as scale from h),
      c as (select *, list_transform(w, lambda x: (greatest(-7, least(7,
        round_even((x / scale)::float::double, 0))) + 8)::int) as c from q)
      select vec_id, string_agg(array_to_string([printf('%02x', c[i] + 16 * c[i + 1])
          for i in range(1, 32, 2)], ''), '' order by k) as packed,
        string_agg(printf('%02x%02x', bits % 256, bits // 256), '' order by k) as scales,
        round(max(list_max([abs(w[i] - ((c[i] - 8) * scale)::float::double)
          for i in range(1, 33)])), 9) as worst
      from c group by vec_id""",
    "quantization_error": """with v as (select vec_id, label, list_transform(embedding,
        lambda x: x::double) as e from embeddings),
      g as (select vec_id, label, unnest([e[i:i+31] for i in range(1, len(e), 32)]) as w from v),
      s as (select vec_id, label, w, greatest(list_max(list_transform(w, lambda x: abs(x))) / 7,
        1e-8::double) as scale from g),
      x as (select vec_id, label, scale, unnest(list_transform(w, lambda x: abs(x - scale *
        greatest(-7, least(7, round_even(x / scale, 0)))))) as err from s)
      select label::bigint as label, count(distinct vec_id) as vectors,
        round(max(err), 9) as max_abs_error, round(avg(err), 9) as mean_abs_error,
        round(max(err / scale), 9) as max_error_steps,
        4 * count(*) as bytes_before, count(*) // 2 + 8 * (count(*) // 32) as bytes_after
      from x group by label""",
    # --- streams ---
    "stream_filter": f"with {USABLE} select doc_id, lang, {SPLIT}, md5(text) as h from us",
    "stream_restore": f"""with {USABLE}, {FORMS}, {restored('ro', 'doc_id')}
      select doc_id, restored from re""",
    "stream_metrics": f"""with {RO}, st as (select lang, text, {strip('text')} as restored from ro),
      {tallies('st', 'lang')} select lang, {metrics()} from ta group by lang""",
}
ORACLES["corrections_beside_validation"] = f"""with {USABLE},
  kn as (select item_id, {fix(f'nfc_normalize({ROMANISED_PLAIN})')} as text from benchmark),
  tr as (select ord, text from us where not valid
    union all select 1000000000 + item_id, text from kn, range(2)),
  {FORMS.replace('from us where not valid', 'from tr')},
  al as (select doc_id, 'valid' as split, text from us where valid
    union all select 'c' || item_id, 'corrections', text from kn),
  {restored('al', 'doc_id', 're0')},
  re as (select split, text, restored from al join re0 using (doc_id)),
  {tallies('re', 'split')}
  select split, {metrics(['candidate_accuracy'])} from ta group by split"""
ORACLES["stream_running_metrics"] = ORACLES["stream_metrics"]
ORACLES["stream_lines"] = f"""with {USABLE}, {FORMS}, li as (select doc_id, concat_ws(chr(9), doc_id,
    translate(text, chr(13) || chr(10), '  ')) as text from ro),
  {restored('li', 'doc_id')},
  r as (select {crc('doc_id')} % 2 as run, ('0x' || substr(md5(restored), 1, 7))::bigint as h
    from re, crct),
  g as (select run, count(*) as n, sum(h) as s from r group by run)
  select run::bigint as run, (sum(n) over (order by run) - n)::bigint as first_no,
    (sum(n) over (order by run) - 1)::bigint as last_no, n as numbers, s::bigint as restored_sum
  from g"""
ORACLES["restore_context_large"] = ORACLES["restore_context"]
