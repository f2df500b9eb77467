"""Scalar functions as column expressions (F01-F12, F17-F34, P03, P04). All stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALLBACK_TYPE = "RELATED_TO"
NO_ITEMS = "(tidak ada)"

# Other names of the within-book relations (directions stay as they are).
ALIASES = {
    "MEMUNGKINKAN": "MEMPENGARUHI",
    "MENGATUR": "MEMPENGARUHI",
    "MENENTUKAN": "MEMPENGARUHI",
    "MENGONTROL": "MEMPENGARUHI",
    "MENGARAHKAN": "MEMPENGARUHI",
    "TERDIRI_DARI": "BAGIAN_DARI",
    "MENGANDUNG": "BAGIAN_DARI",
    "MEMILIKI": "BAGIAN_DARI",
    "BEREAKSI_DENGAN": "BERINTERAKSI_DENGAN",
    "BERKAITAN_DENGAN": "BERINTERAKSI_DENGAN",
    "BERHUBUNGAN_DENGAN": "BERINTERAKSI_DENGAN",
    "BERASOSIASI_DENGAN": "BERINTERAKSI_DENGAN",
    "MENIMBULKAN": "MENYEBABKAN",
    "MENGHASILKAN": "MENYEBABKAN",
    "MEMPRODUKSI": "MENYEBABKAN",
    "MENGHASILKAN_PRODUK": "MENYEBABKAN",
    "TAHAP_DARI": "BAGIAN_DARI",
    "LANGKAH_DARI": "BAGIAN_DARI",
    "TAHAPAN_DARI": "BAGIAN_DARI",
    "LANGKAH_DALAM": "BAGIAN_DARI",
    "MEMBUTUHKAN": "BERGANTUNG_PADA",
    "MENGGUNAKAN": "BERGANTUNG_PADA",
    "MEMERLUKAN": "BERGANTUNG_PADA",
    "MENJELASKAN": "MENDEFINISIKAN",
    "MENGURAIIKAN": "MENDEFINISIKAN",
    "MENGGAMBARKAN": "MENDEFINISIKAN",
    "DIUKUR_DENGAN": "DIFORMULASIKAN_SEBAGAI",
    "DIREPRESENTASIKAN_SEBAGAI": "DIFORMULASIKAN_SEBAGAI",
}
# Vector lengths of embedding models; the first name that is contained decides.
DIMENSIONS = (
    ("gemini-embedding", 3072),
    ("text-embedding-3-small", 1536),
    ("text-embedding-3-large", 3072),
    ("multilingual-e5-small", 384),
    ("bge-small", 384),
    ("bge-base", 768),
    ("bge-large", 1024),
    ("Qwen3-Embedding", 4096),
)
# Words that link no concepts.
STOPWORDS = (
    "dan", "atau", "yang", "di", "ke", "dari", "untuk", "pada", "dengan", "dalam",
    "suatu", "adalah", "merupakan", "sebagai", "oleh", "itu", "ini", "bab", "materi",
    "konsep", "proses", "sistem", "bagian", "jenis", "teori", "hukum", "kelas", "xii",
)
# Formats of variables, headings and page text.
VARIABLE = r"^([^\s(]+)\s*\(([^,)]+)(?:,\s*([^)]+))?\)"
BAB = r"(?i)^\s*(BAB\s+[IVXLCDM\d]+[:\.\s]*.{0,60})"
SUBBAB = r"(?i)^\s*([A-Z]\.\s+\S.{0,80}|\d+\.\d+\s+\S.{0,80}|(?:Subbab|Sub-Bab)\s+.{0,60})"
CLEANING = (
    (r"-\s*\n\s*", ""),
    (r"[\n\t\r]+", " "),
    (r"(?U)(?<!\w)\d{1,3}(?!\w)", ""),
    (r"(?U)\b([A-Z]{2,}(\s+[A-Z]{2,}){0,3})\b", ""),
    (r"[^\x20-\x7E\u00C0-\u024F\u1E00-\u1EFF]", " "),
    (r" {2,}", " "),
)
DEFAULT_DIMENSION = 768


def either(a: str | Column, b: str | Column) -> Column:
    """a unless it is null or empty, else b."""
    return F.coalesce(F.nullif(a if isinstance(a, Column) else F.col(a), F.lit("")), b if isinstance(b, Column) else F.col(b))


def relation_type(c: Column) -> Column:
    """Relation name as a graph type: upper case, white space and hyphens to _, others dropped, RELATED_TO if nothing is left, _ before a digit."""
    t = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"[\s-]+", "_"), "[^A-Z0-9_]", "")
    t = F.when(F.coalesce(t, F.lit("")) == "", FALLBACK_TYPE).otherwise(t)
    return F.when(t.rlike("^[0-9]"), F.concat(F.lit("_"), t)).otherwise(t)


def relation_type_replacing(c: Column) -> Column:
    """Variant: each character not allowed becomes _."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9_]", "_")


def relation_type_spaces(c: Column) -> Column:
    """Variant: only spaces and hyphens become _."""
    return F.translate(F.upper(c), " -", "__")


def canonical_type(c: Column, canonical: tuple[str, ...], aliases: dict[str, str] = ALIASES) -> Column:
    """Canonical within-book relation, null for an unknown one."""
    t = F.upper(F.trim(c))
    names = F.create_map(*[F.lit(x) for kv in [*aliases.items(), *((n, n) for n in canonical)] for x in kv])
    return names[t]


def name_key(c: Column) -> Column:
    """Trimmed, lower case, single spaces."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def tokens(c: Column, stopwords: tuple[str, ...] = (), least: int = 4) -> Column:
    """Distinct tokens of [a-z0-9] of a least length without stopwords."""
    plain = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " ")), " ")
    keep = F.filter(F.array_distinct(plain), lambda t: F.length(t) >= least)
    return F.array_except(keep, F.array(*[F.lit(s) for s in stopwords])) if stopwords else keep


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays of doubles; null if one is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def unit(v: str) -> Column:
    """The vector at length 1, null if it is all zeros."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    return F.when(norm > 0, F.transform(v, lambda e: e / norm))


def index_score(cos: Column) -> Column:
    """(1 + cosine) / 2."""
    return (1 + cos) / 2


def cache_key(*parts: Column, separator: str = "\x1f") -> Column:
    """sha256 of the parts; a separator keeps their borders apart, '' gives the old keys."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def _json(c: Column) -> Column:
    """A string as JSON, null as null."""
    return F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""), F.lit("null"))


def _json_list(items: Column, one) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(items, F.array()), one), ", "), F.lit("]"))


def fingerprint(chapter_a: Column, edges_a: Column, chapter_b: Column, edges_b: Column, shared: Column) -> Column:
    """12 hex digits of a pair's context: md5 of JSON with sorted keys and ", " and ": " between them (F10). Edges: (rel_type, target, confidence)."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    edge = lambda e: F.concat(F.lit('{"confidence": '), number(e["confidence"]), F.lit(', "rel_type": '), _json(e["rel_type"]), F.lit(', "target": '), _json(e["target"]), F.lit("}"))
    side = lambda chapter, edges: F.concat(F.lit('{"bab": '), _json(chapter), F.lit(', "edges": '), _json_list(edges, edge), F.lit("}"))
    blob = F.concat(F.lit('{"a": '), side(chapter_a, edges_a), F.lit(', "b": '), side(chapter_b, edges_b), F.lit(', "shared": '), _json_list(shared, _json), F.lit("}"))
    return F.substring(F.md5(blob.cast("binary")), 1, 12)


def pair_text(a: Column, b: Column, schema: str, context: Column) -> Column:
    """Cache text of a pair, the same for both orders."""
    return F.concat_ws("||", F.lit(schema), F.least(a, b), F.greatest(a, b), context)


def variable(c: Column) -> Column:
    """'F (gaya, N)' as name, label and unit, empty where not given; what has another form is a name; blank is null."""
    t = F.trim(c)
    fits = t.rlike(VARIABLE)
    part = lambda k: F.when(fits, F.trim(F.regexp_extract(t, VARIABLE, k))).otherwise("")
    name = F.when(fits, part(1)).otherwise(t)
    return F.when(t != "", F.struct(name.alias("name"), part(2).alias("label"), part(3).alias("unit")))


def roman(c: Column) -> Column:
    """Value of a roman numeral, null if it is none."""
    s = F.upper(F.trim(c))
    value = F.create_map(*[F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv])
    digits = F.transform(F.split(s, ""), lambda d: value[d])
    signed = F.transform(digits, lambda v, i: F.when(v < F.coalesce(F.get(digits, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(s.rlike("^[IVXLCDM]+$"), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def page_label(c: Column) -> Column:
    """Number of a page label, arabic or roman; 0 if it is neither."""
    return F.coalesce(F.when(F.trim(c).rlike("^[0-9]{1,9}$"), F.trim(c).cast("int")), roman(c), F.lit(0))


def heading_level(text: Column, size: Column, flags: Column, median: Column) -> Column:
    """bab, subbab or body from text, font size against the median, and the bold bit 16."""
    bold = flags.bitwiseAND(16) > 0
    return (
        F.when(text.rlike(BAB), "bab").when(text.rlike(SUBBAB) & (bold | (size > median)), "subbab")
        .when(bold & (size >= median * 1.35), "bab").when(bold & (size >= median * 1.15), "subbab").otherwise("body")
    )


def clean_text(c: Column) -> Column:
    """Page text in six steps: joined hyphens, joined lines, lone numbers, short runs of capitals, printable characters, spaces."""
    for pattern, by in CLEANING:
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


def cut_to(c: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(c, 1, n)


def listing(items: Column, empty: str = NO_ITEMS) -> Column:
    """Items joined by commas, a placeholder for none."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, empty).otherwise(F.array_join(items, ", "))


def edge_lines(edges: Column, most: int | None = None) -> Column:
    """Indented lines '- TYPE → "target" (conf: 0.90)', the confidence only if known, '+N more' beyond ``most``, a placeholder for none."""
    conf = lambda e: F.when(e["confidence"].isNotNull(), F.format_string(" (conf: %.2f)", e["confidence"])).otherwise("")
    line = lambda e: F.concat(F.lit("  - "), e["rel_type"], F.lit(' → "'), e["target"], F.lit('"'), conf(e))
    text = F.array_join(F.transform(edges if most is None else F.slice(edges, 1, most), line), "\n")
    if most is not None:
        text = F.when(F.size(edges) > most, F.concat(text, F.format_string("\n  +%d more", F.size(edges) - most))).otherwise(text)
    return F.when(F.coalesce(F.size(edges), F.lit(0)) <= 0, "  " + NO_ITEMS).otherwise(text)


# Lines of a context block. %s stand for name, chapter and edges of A and of B with a note, shared neighbours and advice.
CONTEXT_LINES = (
    "========================", "KONTEKS GRAF (HUBUNGAN YANG SUDAH ADA)", "========================", 'Konsep A ("%s") berada di Bab: %s', "Hubungan A yang sudah ada di graf:", "%s", "",
    'Konsep B ("%s") berada di Bab: %s %s', "Hubungan B yang sudah ada di graf:", "%s", "", "Tetangga bersama (target yang sama-sama dirujuk A dan B): %s", "", "%s",
)


def neighbourhood(name_a: Column, chapter_a: Column, edges_a: Column, name_b: Column, chapter_b: Column, edges_b: Column, shared: Column, advice: str = "") -> Column:
    """Context block of a pair, empty if nothing is known."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    a, b = F.nullif(chapter_a, F.lit("")), F.nullif(chapter_b, F.lit(""))
    unknown = F.lit("(tidak diketahui)")
    note = F.when(a.isNull() | b.isNull(), "").when(a == b, "(Bab yang sama)").otherwise("(Bab berbeda)")
    block = F.format_string("\n".join(CONTEXT_LINES), name_a, F.coalesce(a, unknown), edge_lines(edges_a), name_b, F.coalesce(b, unknown), note, edge_lines(edges_b), listing(shared), F.lit(advice))
    return F.when(a.isNotNull() | b.isNotNull() | some(edges_a) | some(edges_b) | some(shared), block).otherwise("")


def pair_block(index: Column, a: dict[str, Column], b: dict[str, Column], context: Column) -> Column:
    """A numbered pair with the named fields of both sides, and its context if there is any."""
    side = lambda name, fields: [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name} {k}: "), c)) for k, c in fields.items()]
    return F.concat_ws("\n", F.concat(F.lit("Pair "), index.cast("string")), *side("A", a), *side("B", b), F.nullif(context, F.lit("")))


def without_prefix(c: Column, prefix: str) -> Column:
    """(F26)"""
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1_000_000)).otherwise(c)


def without_fences(c: Column) -> Column:
    """JSON text without Markdown code fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def model_dimension(c: Column) -> Column:
    """Vector length of a model name."""
    out = F.lit(DEFAULT_DIMENSION)
    for name, n in reversed(DIMENSIONS):
        out = F.when(F.contains(F.lower(c), F.lit(name)), n).otherwise(out)
    return F.when(c.isNotNull(), out)


def distinct_ignoring_case(items: Column) -> Column:
    """First spelling of each item, in order."""
    lower = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def without_contained(items: Column) -> Column:
    """Items that no other item contains."""
    return F.filter(items, lambda x: ~F.exists(items, lambda o: (F.lower(o) != F.lower(x)) & F.contains(F.lower(o), F.lower(x))))


def sweep_tag(threshold: Column, k: Column) -> Column:
    """t085_k5 (F30)."""
    return F.format_string("t%03d_k%d", F.round(threshold * 100).cast("int"), k)


# Run parameters that are looked for in notebooks.
PARAMETERS = {
    "model_id": r"(?:model[_ ]name|model_id|model\s*=)[\s:=]+[\"']([\w\-/.\d:]+)[\"']",
    "temperature": r"temperature\s*[=:]\s*([\d.]+)",
    "top_p": r"top_p\s*[=:]\s*([\d.]+)",
    "top_k": r"(?<!_)top_k\s*[=:]\s*([\d]+)",
    "max_tokens": r"(?:max_(?:output_)?tokens|maxOutputTokens)\s*[=:]\s*([\d]+)",
    "candidate_count": r"candidate_count\s*[=:]\s*([\d]+)",
    "chunk_size": r"chunk_size\s*[=:]\s*([\d]+)",
    "chunk_overlap": r"chunk_overlap\s*[=:]\s*([\d]+)",
    "embed_model": r"(?:embed(?:ding)?_?model)[\s=:]+[\"']([\w\-/.\d:]+)[\"']",
    "output_dim": r"output_dim(?:ensionality)?\s*[=:]\s*([\d]+)",
    "embed_task_type": r"task_type\s*[=:]\s*[\"']([\w_]+)[\"']",
    "batch_size": r"batch_size\s*[=:]\s*([\d]+)",
    "seed": r"(?<!\w)seed\s*[=:]\s*([\d]+)",
    "response_mime": r"response_mime_type\s*[=:]\s*[\"']([^\"']+)[\"']",
    "safety": r"(safety_settings)",
    "threshold": r"(?:similarity_)?threshold\s*[=:]\s*([\d.]+)",
    "cosine": r"(cosine)",
    "GenerationConfig": r"(GenerationConfig\s*\()",
    "genai_Client": r"(genai\.Client\()",
    "pydantic": r"(BaseModel|response_schema|response_model)",
    "cache": r"(cache|sha256|hashlib)",
}


def scraped(c: Column, patterns: dict[str, str] = PARAMETERS) -> Column:
    """Map of name -> all first groups of a pattern."""
    return F.create_map(*[x for name, p in patterns.items() for x in (F.lit(name), F.regexp_extract_all(c, F.lit(p), F.lit(1)))])


def percentage(share: Column, digits: int = 1) -> Column:
    """'93.4%'; ties to even."""
    return F.concat(F.bround(share * 100, digits).cast("string"), F.lit("%"))


def older_than(day: Column, today: Column, days: int) -> Column:
    """Age cutoff against a given day."""
    return F.to_date(day) < F.date_sub(today, days)


def embed_text(name: Column, description: Column, extras: list[tuple[str, Column]], style: str = "a") -> Column:
    """Text that is embedded: 'name. description Rumus: x, y' and the other habits.

    a: sentences with labelled lists; b: labelled single fields; dots: joined by '. '; colon: 'name: description'.
    """
    text = F.nullif(description, F.lit(""))
    if style == "colon":
        return F.concat_ws(": ", name, text)
    if style == "dots":
        return F.concat_ws(". ", name, text, *[F.nullif(c, F.lit("")) for _, c in extras])
    if style == "a":
        parts = [F.when(F.size(c) > 0, F.concat(F.lit(f"{k}: "), F.array_join(c, ", "))) for k, c in extras]
    else:
        parts = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k}: "), c)) for k, c in extras]
    return F.concat_ws(" ", F.concat(name, F.lit(".")), text, *parts)
