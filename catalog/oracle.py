"""SQL that DuckDB runs on the same tables to check the registered queries."""

from __future__ import annotations

from typing import NamedTuple

CHUNK = 100
PART_BYTES = 400_000


class BloomShape(NamedTuple):
    m: int
    k: int


class BandShape(NamedTuple):
    bands: int
    rows: int


# Plain values, worked out apart from the engine: filters for (300, 0.05),
# (1000, 0.01) and (100000, 0.001); bands of 150 hashes for a threshold.
SMALL_BLOOM = BloomShape(1870, 4)
USUAL_BLOOM = BloomShape(9585, 6)
LARGE_BLOOM = BloomShape(1_437_758, 9)
BANDS = {0.8: BandShape(11, 13), 0.7: BandShape(16, 9)}
PRIME = 2147483647
WORD_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85]"


def coefficients(count: int) -> list[tuple[int, int]]:
    """Pairs (a, b): powers 1, 2, 3, ... of 48271 modulo the prime, two by two."""
    return [
        (pow(48271, 2 * i + 1, PRIME), pow(48271, 2 * i + 2, PRIME)) for i in range(count)
    ]

BLANKS = (
    r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
LINE_BREAKS = r"\r\n|[\n\x0B\x0C\r\x{85}\x{2028}\x{2029}]"


# --- exact ---------------------------------------------------------------------------

EXACT = """ex as (select doc_id, text, min(doc_id) over (partition by md5(text)) owner_id
               from documents)"""


def exact_dropped() -> str:
    return f"{EXACT}, dr as (select doc_id, owner_id from ex where doc_id <> owner_id)"


# --- Bloom ---------------------------------------------------------------------------

def hex_mod(h: str, m: int) -> str:
    digits = 8 if m < 1 << 31 else 4
    words = [f"('0x'||substr({h},{at + 1},{digits}))::BIGINT" for at in range(0, 64, digits)]
    value = f"({words[0]} % {m})"
    for word in words[1:]:
        value = f"(({value} * {1 << 4 * digits} + {word}) % {m})"
    return value


def bits(name: str, prints: str, ident: str, shape: BloomShape) -> str:
    """CTE ``name(ident, i, bit)`` over ``prints(ident, fp)``."""
    return f"""{name}_h as (select {ident}, i, sha256(fp || i::varchar) h
                 from {prints}, range({shape.k}) t(i)),
        {name} as (select {ident}, i, {hex_mod('h', shape.m)} bit from {name}_h)"""


def text_prints(table: str = "documents", ident: str = "doc_id", column: str = "text") -> str:
    return f"(select {ident}, sha256({column}::varchar) fp from {table})"


def bloom_kept(prints: str, shape: BloomShape, ident: str = "doc_id", head: str = "") -> str:
    return f"""with {head} {bits('bt', prints, ident, shape)}
        select distinct {ident} from (select min({ident}) {ident} from bt group by bit)"""


def saturation(prints: str, shape: BloomShape, every: int | str, head: str = "") -> str:
    return f"""with {head} {bits('bt', prints, 'doc_id', shape)},
        fs as (select min(doc_id) f from bt group by bit),
        st as (select doc_id // {every} step, count(*) r from documents group by 1),
        fr as (select f // {every} step, count(*) b from fs group by 1)
        select step, (sum(r) over (order by step))::BIGINT processed_docs,
               (sum(coalesce(b, 0)) over (order by step))::BIGINT bits_set,
               round(sum(coalesce(b, 0)) over (order by step) / {shape.m}.0::DOUBLE, 6)
                 bloom_saturation,
               round(100 * (sum(coalesce(b, 0)) over (order by step) / {shape.m}.0::DOUBLE), 6)
                 bloom_saturation_percent
        from st left join fr using (step)"""


# --- MinHash -------------------------------------------------------------------------

def family(count: int) -> str:
    values = ", ".join(f"({i},{a},{b})" for i, (a, b) in enumerate(coefficients(count)))
    return f"cf(i,a,b) as (values {values})"


def token_hash(column: str) -> str:
    return f"('0x'||substr(md5({column}),1,8))::BIGINT % {PRIME}"


def signed(count: int, tokens: str, source: str = "documents", ids: str = "documents") -> str:
    """CTE ``sg(doc_id, i, s)`` over a per-document list expression ``tokens``."""
    return f"""{family(count)},
        tk as (select doc_id, {token_hash('u')} h
               from (select doc_id, unnest({tokens}) u from {source})),
        mn as (select doc_id, i, min((a::BIGINT * h + b) % {PRIME}) s from tk, cf group by 1, 2),
        sg as (select d.doc_id, cf.i, coalesce(mn.s, {PRIME}) s
               from (select doc_id from {ids}) d cross join cf
               left join mn on mn.doc_id = d.doc_id and mn.i = cf.i)"""


WORDS = f"list_distinct(regexp_extract_all(text, '{WORD_PATTERN}'))"
SPLIT = f"list_filter(regexp_split_to_array(text, '{BLANKS}'), lambda w: w <> '')"
SPLIT_DOCS = f"(select doc_id, {SPLIT} w from documents)"
SHINGLES = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


def banded(count: int, shape: BandShape, rows: str = "documents") -> str:
    return f"""{signed(count, WORDS, rows, rows)},
        kb as (select doc_id, i // {shape.rows} band,
                      md5((i // {shape.rows})::varchar || ':'
                          || string_agg(s::varchar, ',' order by i)) k
               from sg where i < {shape.bands * shape.rows} group by 1, 2)"""


def first_match(
    count: int = 150, threshold: float = 0.8, rows: str = "documents", before: str = ""
) -> str:
    """CTEs ``mt(doc_id, owner_id)``, all kept matches, and ``dr``, the lowest of each."""
    shape = BANDS[threshold]
    return f"""recursive {before} {banded(count, shape, rows)},
        sh as (select k from kb group by k having count(*) > 1),
        cand as (select doc_id, list(k) ks, row_number() over (order by doc_id) rn
                 from kb where k in (select k from sh) group by doc_id),
        g(rn, doc_id, keep, acc) as (
          select 0::BIGINT, -1::BIGINT, false, []::VARCHAR[]
          union all
          select cand.rn, cand.doc_id, not list_has_any(g.acc, cand.ks),
                 case when list_has_any(g.acc, cand.ks) then g.acc
                      else list_concat(g.acc, cand.ks) end
          from g join cand on cand.rn = g.rn + 1),
        mt as (select distinct x.doc_id, y.doc_id owner_id
               from kb x join kb y on x.k = y.k and y.doc_id < x.doc_id
               where y.doc_id in (select doc_id from g where keep)),
        dr as (select doc_id, min(owner_id) owner_id from mt group by doc_id)"""


# --- shared reports ------------------------------------------------------------------

COUNTS = f"""cn as (select chunk, original, original - coalesce(removed, 0) kept,
                           coalesce(removed, 0) removed
             from (select doc_id // {CHUNK} chunk, count(*) original from documents group by 1)
             left join (select doc_id // {CHUNK} chunk, count(*) removed from dr group by 1)
             using (chunk))"""


def group_sizes(head: str) -> str:
    return f"with {head} select owner_id, count(*) + 1 group_size from dr group by 1"


def top_groups(head: str) -> str:
    return f"""with {head}, gs as (select owner_id, count(*) + 1 group_size from dr group by 1)
        select owner_id, group_size,
               case when length(text) > 200 then substr(text, 1, 200) || '...' else text end
                 text_sample
        from gs join documents on doc_id = owner_id
        order by group_size desc, owner_id limit 10"""


def duplicate_count(head: str) -> str:
    return f"""with {head}, gs as (select owner_id, count(*) n from dr group by 1)
        select doc_id, coalesce(n, 0) duplicate_count from documents
        left join gs on owner_id = doc_id
        where doc_id not in (select doc_id from dr)"""


def ordinal(head: str) -> str:
    return f"""with {head} select doc_id, owner_id,
        row_number() over (partition by owner_id order by doc_id) ordinal from dr"""


def shifted_count(head: str) -> str:
    return f"""with {head},
        od as (select doc_id, row_number() over (partition by owner_id order by doc_id) o from dr),
        al as (select doc_id, o, doc_id // {CHUNK} c,
                      row_number() over (partition by doc_id // {CHUNK} order by doc_id) i
               from documents left join od using (doc_id)),
        kp as (select doc_id, c, row_number() over (partition by c order by doc_id) i
               from al where o is null)
        select kp.doc_id, coalesce(al.o, 0)::BIGINT duplicate_count
        from kp join al on al.c = kp.c and al.i = kp.i"""


def chunk_metrics(head: str) -> str:
    return f"""with {head}, {COUNTS}
        select chunk + 1 chunk_index, original chunk_original_count,
               kept chunk_deduplicated_count, removed chunk_duplicates_removed,
               round(kept / original, 6) chunk_compression_ratio from cn"""


EXACT_RATIO = "(sum(removed) over (order by chunk)) / original"
MINHASH_RATIO = "(sum(removed) over (order by chunk)) / (sum(original) over (order by chunk))"


def exact_running(head: str) -> str:
    return f"""with {head}, {COUNTS}
        select chunk + 1 chunk_index, original processed_total, kept unique_docs,
               (sum(removed) over (order by chunk))::BIGINT duplicates,
               round(({EXACT_RATIO})::DOUBLE, 6) duplicate_ratio from cn"""


def minhash_running(head: str) -> str:
    return f"""with {head}, {COUNTS}
        select chunk + 1 chunk_index,
               (sum(original) over (order by chunk))::BIGINT processed_total,
               original chunk_size, kept chunk_kept, removed chunk_duplicates,
               (sum(kept) over (order by chunk))::BIGINT global_unique,
               (sum(removed) over (order by chunk))::BIGINT global_duplicates,
               round(({MINHASH_RATIO})::DOUBLE, 6) duplicate_ratio from cn"""


def summary(head: str, ratio: str | None) -> str:
    mean = (
        "0.0::DOUBLE" if ratio is None
        else f"(select round(avg(r), 6) from (select ({ratio})::DOUBLE r from cn))"
    )
    return f"""with {head}, {COUNTS}
        select sum(original)::BIGINT total_original_count,
               sum(kept)::BIGINT total_deduplicated_count,
               sum(removed)::BIGINT total_duplicates_removed,
               round((sum(kept) / sum(original))::DOUBLE, 6) total_compression_ratio,
               {mean} avg_duplicate_ratio
        from cn"""


def share(head: str) -> str:
    return f"""with {head}, {COUNTS}, t as (select sum(kept) k, sum(removed) r from cn)
        select 'Unique' as "label", k::BIGINT documents, round(100 * (k / (k + r))::DOUBLE, 6)
          "percent" from t
        union all
        select 'Duplicates', r::BIGINT, round(100 * (r / (k + r))::DOUBLE, 6) from t"""


def trend(head: str) -> str:
    return f"""with {head}, {COUNTS}
        select chunk + 1 chunk_index, original original_count, kept deduplicated_count from cn"""


def pair_sample(head: str, parameter: str) -> str:
    return f"""with {head},
        rk as (select *, row_number() over (partition by doc_id // {CHUNK} order by doc_id) rn
               from dr)
        select rk.doc_id // {CHUNK} chunk, rk.doc_id, rk.owner_id, o.text original,
               d.text duplicate, '{parameter}' parameter
        from rk join documents d on d.doc_id = rk.doc_id
        join documents o on o.doc_id = rk.owner_id where rn <= 10"""


def pair_table(head: str, parameter: str) -> str:
    return f"""select dr_original as "Original", dr_duplicate as "Duplicate",
               '{parameter}' as "Parameter", same_lines, gone_lines, new_lines from (
        select o.text dr_original, d.text dr_duplicate, l.unchanged_lines same_lines,
               l.removed_lines gone_lines, l.added_lines new_lines,
               row_number() over (partition by l.doc_id // {CHUNK} order by l.doc_id) rn
        from ({line_diff(head)}) l join documents d on d.doc_id = l.doc_id
        join documents o on o.doc_id = l.owner_id) where rn <= 10"""


def stream_running(head: str) -> str:
    step = "(select max(doc_id) // 4 + 1 from documents)"
    return f"""with {head},
        cn as (select chunk, original, original - coalesce(removed, 0) kept,
                      coalesce(removed, 0) removed
               from (select doc_id // {step} chunk, count(*) original from documents group by 1)
               left join (select doc_id // {step} chunk, count(*) removed from dr group by 1)
               using (chunk))
        select chunk + 1 chunk_index, original processed_total, kept unique_docs,
               (sum(removed) over (order by chunk))::BIGINT duplicates,
               round(({EXACT_RATIO})::DOUBLE, 6) duplicate_ratio from cn"""


def csv_rows(head: str, threshold: float) -> str:
    return f"""with {head}, gs as (select owner_id, count(*) + 1 n from dr group by 1)
        select 'doc_' || dr.owner_id group_id, n group_size, md5(o.text) original_md5,
               md5(d.text) duplicate_md5, {threshold}::DOUBLE similarity_threshold
        from dr join gs using (owner_id) join documents d on d.doc_id = dr.doc_id
        join documents o on o.doc_id = dr.owner_id"""


def pair_dump(head: str) -> str:
    rule = "-" * 24
    return f"""with {head}
        select 'Current Text:' || chr(10) || d.text || chr(10) || chr(10) || 'Matched With:'
               || chr(10) || o.text || chr(10) || '{rule}' as value
        from dr join documents d on d.doc_id = dr.doc_id
        join documents o on o.doc_id = dr.owner_id"""


def split_lines(text: str) -> str:
    parts = f"regexp_split_to_array({text}, '{LINE_BREAKS}')"
    return f"case when {parts}[-1] = '' then {parts}[:-2] else {parts} end"


def line_diff(head: str) -> str:
    split = split_lines

    def joined(lines: str) -> str:
        return f"array_to_string(list_sort({lines}), chr(10))"

    return f"""with {head},
        ln as (select dr.doc_id, dr.owner_id, {split('o.text')} a, {split('d.text')} b
               from dr join documents d on d.doc_id = dr.doc_id
               join documents o on o.doc_id = dr.owner_id),
        df as (select doc_id, owner_id,
                 list_distinct(list_filter(a, lambda x: list_contains(b, x))) same,
                 list_distinct(list_filter(a, lambda x: not list_contains(b, x))) gone,
                 list_distinct(list_filter(b, lambda x: not list_contains(a, x))) fresh from ln)
        select doc_id, owner_id, len(same)::BIGINT unchanged_lines, len(gone)::BIGINT removed_lines,
               len(fresh)::BIGINT added_lines, {joined('gone')} removed,
               {joined('fresh')} added from df"""


def ordered_diff(head: str) -> str:
    """The table of common lines by suffix, a row per line of the copy from its end, then the
    walk through it.  ``head`` begins with ``recursive``."""
    return f"""with {head},
        ln as materialized (select dr.doc_id, dr.owner_id, {split_lines('o.text')} a,
                 {split_lines('d.text')} b
               from dr join documents d on d.doc_id = dr.doc_id
               join documents o on o.doc_id = dr.owner_id),
        dp(doc_id, j, vals) as (
          select doc_id, len(b) + 1, list_transform(range(len(a) + 1), lambda x: 0) from ln
          union all
          select doc_id, j, list_transform(range(1, len(cand) + 1),
                   lambda i: list_max(list_slice(cand, i, len(cand))))
          from (select dp.doc_id, dp.j - 1 j, list_transform(range(1, len(a) + 2), lambda i:
                    greatest(vals[i], case when i <= len(a) and a[i] = b[dp.j - 1]
                                           then vals[i + 1] + 1 else 0 end)) cand
                from dp join ln on ln.doc_id = dp.doc_id where dp.j > 1)),
        tb as materialized (select * from dp),
        wk(doc_id, i, j, line_number, op) as (
          select doc_id, 1::BIGINT, 1::BIGINT, 0::BIGINT, '' from ln
          union all
          select doc_id, case op when 'added' then i else i + 1 end,
                 case op when 'removed' then j else j + 1 end, line_number + 1, op
          from (select wk.doc_id, wk.i, wk.j, wk.line_number,
                  case when wk.j > len(b) then 'removed' when wk.i > len(a) then 'added'
                       when a[wk.i] = b[wk.j] then 'same'
                       when here.vals[wk.i + 1] >= after.vals[wk.i] then 'removed'
                       else 'added' end op
                from wk join ln on ln.doc_id = wk.doc_id
                left join tb here on here.doc_id = wk.doc_id and here.j = wk.j
                left join tb after on after.doc_id = wk.doc_id and after.j = wk.j + 1
                where wk.i <= len(a) or wk.j <= len(b)))
        select wk.doc_id, owner_id, line_number, op,
               case op when 'added' then b[j - 1] else a[i - 1] end line
        from wk join ln on ln.doc_id = wk.doc_id where op <> ''"""


def jaccard(matches: str, head: str) -> str:
    """CTE ``jc(doc_id, owner_id, j)``"""
    return f"""{head},
        st as (select doc_id, {WORDS} w from documents),
        pr as (select m.doc_id, m.owner_id, len(list_intersect(a.w, b.w)) common,
                      len(a.w) + len(b.w) total
               from {matches} m join st a on a.doc_id = m.doc_id
               join st b on b.doc_id = m.owner_id),
        jc as (select doc_id, owner_id, common / (total - common) j from pr)"""


HISTOGRAM = """en as (select min(j) lo, max(j) hi, (max(j) - min(j)) / 20 width from jc),
        hs as (select least(20, floor(20 * (j - lo) / (hi - lo))::INTEGER + 1) bin, count(*) n
               from jc, en group by 1)"""
HISTOGRAM_ROWS = """select bin::INTEGER bin, round(lo + (bin - 1) * width, 6) low,
               round(lo + bin * width, 6) high, coalesce(n, 0)::BIGINT pairs
        from range(1, 21) r(bin) left join hs using (bin), en"""


def exact_ctes(name: str = "dr_exact") -> str:
    return f"""ex as (select doc_id, min(doc_id) over (partition by md5(text)) owner_id
               from documents),
        {name} as (select doc_id, owner_id from ex where doc_id <> owner_id)"""


def hybrid_prints(tokens: str = SHINGLES, source: str = SPLIT_DOCS) -> str:
    """CTEs that end in ``hp(doc_id, fp)``."""
    return f"""{signed(128, tokens, source)},
        hp as (select doc_id, sha256(string_agg(s::varchar, ',' order by i)) fp
               from sg group by doc_id)"""


def overlap() -> str:
    bloom = LARGE_BLOOM
    return f"""with {first_match()}, {exact_ctes()},
        {bits('eb', text_prints(), 'doc_id', bloom)},
        dr_bloom as (select doc_id from documents where doc_id not in
                     (select min(doc_id) from eb group by bit)),
        hcf as (select * from (values {', '.join(f'({i},{a},{b})' for i, (a, b) in enumerate(coefficients(128)))}) v(i,a,b)),
        htk as (select doc_id, {token_hash('u')} h
                from (select doc_id, unnest({SHINGLES}) u from {SPLIT_DOCS})),
        hmn as (select doc_id, i, min((a::BIGINT * h + b) % {PRIME}) s from htk, hcf group by 1, 2),
        hp as (select d.doc_id, sha256(string_agg(coalesce(hmn.s, {PRIME})::varchar, ','
                      order by hcf.i)) fp
               from (select doc_id from documents) d cross join hcf
               left join hmn on hmn.doc_id = d.doc_id and hmn.i = hcf.i group by d.doc_id),
        {bits('hb', 'hp', 'doc_id', bloom)},
        dr_hybrid as (select doc_id from documents where doc_id not in
                      (select min(doc_id) from hb group by bit)),
        fl as (select doc_id, doc_id in (select doc_id from dr_exact) by_exact,
                      doc_id in (select doc_id from dr) by_minhash,
                      doc_id in (select doc_id from dr_bloom) by_bloomfilter,
                      doc_id in (select doc_id from dr_hybrid) by_minhash_bloom_hybrid
               from documents)
        select by_exact, by_minhash, by_bloomfilter, by_minhash_bloom_hybrid, count(*) documents
        from fl where by_exact or by_minhash or by_bloomfilter or by_minhash_bloom_hybrid
        group by all"""


def all_sql() -> dict[str, str]:
    ex, mh = exact_dropped(), first_match()
    mh7 = first_match(threshold=0.7)
    kept = "select doc_id from documents where doc_id not in (select doc_id from dr)"
    hybrid = hybrid_prints()
    lang_prints = hybrid_prints("[lang]", "documents")
    return {
        "exact_fingerprints": "select doc_id, md5(text) fp from documents",
        "exact_kept": "select min(doc_id) doc_id from documents group by md5(text)",
        "exact_rows": f"with {ex} select * from documents where doc_id not in "
                      "(select doc_id from dr)",
        "exact_dropped_rows": f"with {ex} select * from documents where doc_id in "
                              "(select doc_id from dr)",
        "exact_dropped_pairs": f"with {ex} select doc_id, owner_id from dr",
        "exact_group_sizes": group_sizes(ex),
        "exact_top_groups": top_groups(ex),
        "exact_duplicate_count": duplicate_count(ex),
        "exact_duplicate_ordinal": ordinal(ex),
        "exact_duplicate_count_compat": shifted_count(ex),
        "exact_pair_sample": pair_sample(ex, "1.0"),
        "chunk_assignment": f"select doc_id, doc_id // {CHUNK} chunk from documents",
        "max_chunks_limit": f"""select doc_id, doc_id // {CHUNK} chunk from documents
                                where doc_id < {3 * CHUNK}""",
        "chunk_metrics": chunk_metrics(ex),
        "exact_chunk_running": exact_running(ex),
        "exact_logged_metrics": f"""select chunk_index, processed_total, duplicate_ratio
                                    from ({exact_running(ex)})""",
        "final_summary": summary(ex, EXACT_RATIO),
        "unique_share": share(ex),
        "compression_trend": trend(ex),
        "chunk_files": f"""with {ex} select doc_id // {CHUNK} chunk, count(*) documents,
                           sum(length(text))::BIGINT chars
                           from documents where doc_id not in (select doc_id from dr) group by 1""",
        "chunk_group_files": f"""with {ex},
            kp as (select *, strlen(text) + strlen(lang) + strlen(source) + 16 size
                   from documents where doc_id not in (select doc_id from dr)),
            rm as (select greatest({PART_BYTES} - max(size), {PART_BYTES} // 2) room from kp),
            bf as (select *, sum(size) over (order by doc_id) - size sofar from kp),
            pt as (select *, dense_rank() over (order by sofar // room) - 1 part from bf, rm)
            select part, min(doc_id // {CHUNK}) first_chunk, max(doc_id // {CHUNK}) last_chunk,
                   count(*) documents, sum(length(text))::BIGINT chars from pt group by part""",
        "registry_custom_method": """select doc_id from documents where doc_id in
            (select min(doc_id) from documents group by lang, source, n_chars)""",
        "bloom_fingerprints": "select doc_id, sha256(text) fp from documents",
        "bloom_bits": f"""with {bits('bt', text_prints(), 'doc_id', USUAL_BLOOM)}
                          select doc_id, i::INTEGER i, bit from bt""",
        "bloom_wide_bits": f"""with {bits('bt', text_prints(), 'doc_id', BloomShape(1 << 40, 4))}
                          select doc_id, i::INTEGER i, bit from bt""",
        "bloom_kept": bloom_kept(text_prints(), USUAL_BLOOM),
        "bloom_kept_undersized": bloom_kept(text_prints(), SMALL_BLOOM),
        "bloom_key_kept": bloom_kept(text_prints(column="n_chars"), LARGE_BLOOM),
        "bloom_saturation": saturation(text_prints(), USUAL_BLOOM, CHUNK),
        "bloom_membership": f"""with {bits('bt', text_prints(), 'doc_id', USUAL_BLOOM)},
            {bits('pb', text_prints('benchmark', 'item_id'), 'item_id', USUAL_BLOOM)}
            select item_id, item_id not in (select item_id from pb
              where bit not in (select bit from bt)) is_member from benchmark""",
        "bloom_packed_membership": f"""with {bits('bt', text_prints(), 'doc_id', USUAL_BLOOM)},
            {bits('pb', text_prints('benchmark', 'item_id'), 'item_id', USUAL_BLOOM)}
            select item_id, item_id not in (select item_id from pb
              where bit not in (select bit from bt)) is_member from benchmark""",
        "bloom_packed_saturation": f"""with {bits('bt', text_prints(), 'doc_id', LARGE_BLOOM)},
            pt as (select lang part, bit from bt join documents using (doc_id)
                   union all select 'all', bit from bt)
            select part, count(distinct bit) bits_set,
                   round(count(distinct bit) / {LARGE_BLOOM.m}.0::DOUBLE, 6) bloom_saturation
            from pt group by part""",
        "bloom_summary": f"""with {bits('bt', text_prints(), 'doc_id', USUAL_BLOOM)},
            dr as (select doc_id from documents where doc_id not in
                   (select min(doc_id) from bt group by bit)), {COUNTS}
            select sum(original)::BIGINT total_original_count,
                   sum(kept)::BIGINT total_deduplicated_count,
                   sum(removed)::BIGINT total_duplicates_removed,
                   round((sum(kept) / sum(original))::DOUBLE, 6) total_compression_ratio,
                   0.0::DOUBLE avg_duplicate_ratio from cn""",
        "word_tokens": f"select doc_id, unnest({WORDS}) token from documents",
        "word_split": f"""select doc_id, len(w)::BIGINT n_words, md5(array_to_string(w, ' '))
                          words_md5 from {SPLIT_DOCS}""",
        "shingles": f"""select doc_id, len(s)::BIGINT n_shingles,
                        md5(array_to_string(list_sort(s), chr(10))) shingles_md5
                        from (select doc_id, {SHINGLES} s from {SPLIT_DOCS})""",
        "minhash_signature": f"""with {signed(150, WORDS)}
            select doc_id, string_agg(s::varchar, ',' order by i) signature from sg group by 1""",
        "minhash_bands": f"""with {banded(150, BANDS[0.8])}
            select doc_id, band::INTEGER band, k bucket from kb""",
        "minhash_kept": f"with {mh} {kept}",
        "minhash_kept_lower_threshold": f"with {mh7} {kept}",
        "minhash_pairs": f"with {mh} select doc_id, owner_id from dr",
        "minhash_matches": f"with {mh} select doc_id, owner_id from mt",
        "minhash_group_sizes": group_sizes(mh),
        "minhash_top_groups": top_groups(mh),
        "minhash_duplicate_count": duplicate_count(mh),
        "minhash_duplicate_ordinal": ordinal(mh),
        "minhash_duplicate_count_compat": shifted_count(mh),
        "minhash_chunk_metrics": chunk_metrics(mh),
        "minhash_chunk_running": minhash_running(mh),
        "minhash_final_summary": summary(mh, MINHASH_RATIO),
        "minhash_pair_sample": pair_sample(mh, "0.8"),
        "pair_line_diff": line_diff(mh),
        "pair_ordered_diff": ordered_diff(mh),
        "pair_csv": csv_rows(mh7, 0.7),
        "pair_dump": pair_dump(mh),
        "jaccard_pairs": f"""with {jaccard('mt', mh)}
            select doc_id, owner_id, round(j, 6) jaccard from jc where j >= 0.8""",
        "similarity_histogram": f"with {jaccard('mt', mh)}, {HISTOGRAM} {HISTOGRAM_ROWS}",
        "similarity_histogram_after_exact": f"""with {jaccard('mt', first_match(
            rows='ek', before=f"{exact_ctes()}, ek as (select * from documents where doc_id "
            "not in (select doc_id from dr_exact)),"))}, {HISTOGRAM} {HISTOGRAM_ROWS}""",
        "pair_table": pair_table(mh, "0.8"),
        "batch_run_rows": f"""with {mh} select doc_id, lang, source, n_chars, doc_id // {CHUNK} chunk
            from documents where doc_id not in (select doc_id from dr)""",
        "batch_run_duplicate_count": duplicate_count(mh),
        "batch_run_two_methods": f"""select doc_id, 'exact' as method from (
              select min(doc_id) doc_id from documents group by md5(text))
            union all select doc_id, 'bloomfilter' from (
              {bloom_kept(text_prints(), SMALL_BLOOM)})""",
        "batch_run_saturation": saturation(text_prints(), USUAL_BLOOM, CHUNK),
        "corpus_with_split_column": """select doc_id, 'all' as part from documents
            union all select doc_id, 'fr' from documents where lang = 'fr'""",
        "positions_by_file": """select row_number() over
              (order by case when doc_id % 3 = 0 then 0 else 1 end, doc_id) - 1 as pos,
            source, n_chars from documents""",
        "batch_run_metrics": f"""select chunk_index, processed_total, chunk_kept, chunk_duplicates,
            global_unique, global_duplicates, duplicate_ratio from ({minhash_running(mh)})""",
        "hybrid_fingerprints": f"with {hybrid} select doc_id, fp from hp",
        "hybrid_kept": bloom_kept("hp", LARGE_BLOOM, head=hybrid + ","),
        "hybrid_kept_undersized": bloom_kept("hp", SMALL_BLOOM, head=hybrid + ","),
        "hybrid_key_kept": bloom_kept("hp", LARGE_BLOOM, head=lang_prints + ","),
        "hybrid_saturation": saturation("hp", USUAL_BLOOM, CHUNK, head=hybrid + ","),
        "method_overlap": overlap(),
        "pages_exact_kept": """select page_id, url from pages where page_id in
                               (select min(page_id) from pages group by md5(html))""",
        "conversations_exact_kept": """with nm as (select *, row_number() over
              (order by conv_id, turn) - 1 pos from conversations)
            select pos, conv_id, turn, role from nm
            where pos in (select min(pos) from nm group by md5(text))""",
        "stream_exact": "select min(doc_id) doc_id from documents group by md5(text)",
        "stream_exact_bucketed": "select min(doc_id) doc_id from documents group by md5(text)",
        "stream_minhash": f"with {mh} {kept}",
        "stream_max_chunks_limit": f"""with n as (
              select max(doc_id) // 4 + 1 as step from documents)
            select min(doc_id) doc_id from documents, n
            where doc_id < floor(2.4 * step)::BIGINT // {CHUNK} * {CHUNK} group by md5(text)""",
        "stream_max_chunks_resumed": "select min(doc_id) doc_id from documents group by md5(text)",
        "stream_bloom": bloom_kept(text_prints(), SMALL_BLOOM),
        "stream_bloom_packed": bloom_kept(text_prints(), LARGE_BLOOM),
        "stream_bloom_saturation": saturation(
            text_prints(), USUAL_BLOOM, "(select max(doc_id) // 4 + 1 from documents)"),
        "stream_hybrid": bloom_kept("hp", SMALL_BLOOM, head=hybrid + ","),
        "stream_chunk_running": stream_running(ex),
        "stream_minhash_pairs": f"with {mh} select doc_id, owner_id from dr",
        "stream_unnumbered_kept": "select min(doc_id) doc_id from documents group by md5(text)",
        "stream_row_chunks": exact_running(ex),
        "stream_final_summary": summary(ex, EXACT_RATIO),
        "stream_top_groups": top_groups(ex),
        "stream_duplicate_count": duplicate_count(ex),
        "stream_pair_sample": pair_sample(ex, "1.0"),
        "stream_custom_method": """select doc_id from documents where doc_id in
            (select min(doc_id) from documents group by lang, source, n_chars)""",
    }
