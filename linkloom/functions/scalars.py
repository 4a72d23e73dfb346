"""Column functions: numbers, casing, names, tokens, sets and paths. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- numbers


def round_half_up(x, digits: int = 2) -> Column:
    """Halves go up, as binary doubles stand: F.round() would round the decimal expansion instead."""
    scale = float(10**digits)
    return F.floor(col(x).cast("double") * scale + 0.5).cast("double") / F.lit(scale)


def ratio(part, whole) -> Column:
    """part / whole, and 0 over nothing."""
    return F.coalesce(F.try_divide(col(part).cast("double"), col(whole).cast("double")), F.lit(0.0))


def confidence(share) -> Column:
    """How far a share is above a half, from 0 to 1."""
    return F.greatest(F.lit(0.0), (col(share) - 0.5) * 2)


# -- casing

KEBAB, SNAKE, PASCAL, CAMEL = "kebab-case", "snake_case", "PascalCase", "camelCase"
#: Tried in this order.
CASINGS = [(KEBAB, r"^[a-z0-9]+(-[a-z0-9]+)+$"), (SNAKE, r"^[a-z0-9]+(_[a-z0-9]+)+$"), (PASCAL, r"^[A-Z][A-Za-z0-9]*$"), (CAMEL, r"^[a-z][A-Za-z0-9]*$")]


def casing(stem) -> Column:
    out = None
    for name, pattern in CASINGS:
        out = F.when(col(stem).rlike(pattern), name) if out is None else out.when(col(stem).rlike(pattern), name)
    return out.otherwise("unknown")


def discriminating(stem) -> Column:
    """A single lower-case word fits three casings, so it can't vote; a leading underscore is a convention of its own."""
    return ~col(stem).rlike(r"^[a-z0-9]+$") & ~col(stem).startswith("_")


def name_words(stem) -> Column:
    """Words of a file stem: at separators, acronym ends, case changes and before digits that follow letters."""
    spaced = F.regexp_replace(col(stem), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda w: w != "")


def identifier_words(name) -> Column:
    """Words of an identifier for likeness of names: the camel rule goes before the acronym rule."""
    spaced = F.regexp_replace(col(name), r"([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.trim(F.regexp_replace(spaced, r"[_ ]+", " "))), " "), lambda w: w != "")


def to_casing(words, target: str) -> Column:
    words = col(words)
    title = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    if target == KEBAB:
        return F.array_join(words, "-")
    if target == SNAKE:
        return F.array_join(words, "_")
    pascal = F.array_join(title, "")
    return pascal if target == PASCAL else F.concat(F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, 2, 1 << 30))


def canonical_name(stem) -> Column:
    """What casings of the same words have in common."""
    plain = F.lower(F.regexp_replace(col(stem), r"[^A-Za-z0-9]+", ""))
    return F.when(plain == "", F.lower(col(stem))).otherwise(plain)


def casing_fits_export(case, export_kind) -> Column:
    """Classes and interfaces may be PascalCase; functions, variables and types camelCase, whatever their neighbours do."""
    kind = col(export_kind)
    return ((col(case) == PASCAL) & kind.isin("class", "interface")) | ((col(case) == CAMEL) & kind.isin("function", "variable", "type"))


# -- tokens

#: The words that are no names.
KEYWORDS = "break case catch class const continue default delete do else export extends false finally for function if import in instanceof let new null return static super switch this throw true try typeof undefined var void while with yield async await of from as type interface enum implements declare abstract readonly override".split()


def normalised(body) -> Column:
    """A body without comments in which literals and names are placeholders."""
    text = F.regexp_replace(col(body), r"(?s)/\*.*?\*/", " ")
    text = F.regexp_replace(text, r"(?m)(^|[^:])//[^\n]*", "$1")
    text = F.regexp_replace(text, r"`(?:[^`\\]|\\.)*`", " \\$S ")
    text = F.regexp_replace(text, r"\"(?:[^\"\\\n]|\\.)*\"", " \\$S ")
    text = F.regexp_replace(text, r"'(?:[^'\\\n]|\\.)*'", " \\$S ")
    text = F.regexp_replace(text, r"(?<![A-Za-z0-9_$])[0-9][0-9_]*(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", "\\$N")
    text = F.regexp_replace(text, rf"(?<![A-Za-z0-9_$])(?!(?:{'|'.join(KEYWORDS)})(?![A-Za-z0-9_$]))(?!\$[SNI](?![A-Za-z0-9_$]))[A-Za-z_$][A-Za-z0-9_$]*", "\\$I")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


TOKEN = r"\$[SNI]|[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+|[^\sA-Za-z0-9_$]"


def tokens(text) -> Column:
    return F.regexp_extract_all(col(text), F.lit(f"({TOKEN})"), F.lit(1))


def words(text) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"([a-z0-9]+)"), F.lit(1))


def bigrams(items) -> Column:
    """Distinct adjacent pairs, in the order of their first places; none for fewer than two items."""
    items = col(items)
    pairs = F.zip_with(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(items) < 2, F.array().cast("array<string>")).otherwise(pairs))


def content_tokens(body, kind) -> Column:
    """What a body is about: literals, and names called or capitalised in functions, or all names in types."""
    text = col(body)
    literals = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"\"((?:[^\"\\\n]|\\.)*)\"", r"'((?:[^'\\\n]|\\.)*)'", r"\b([0-9]+(?:\.[0-9]+)?)\b")]))
    calls = F.regexp_extract_all(text, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\("), F.lit(1))
    capitals = F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z0-9_$]*)"), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))
    reserved = F.array(*[F.lit(k) for k in KEYWORDS])
    return F.array_distinct(F.array_except(F.when(col(kind) == "function", F.concat(literals, calls, capitals)).otherwise(F.concat(literals, names)), reserved))


# -- sets


def jaccard(a, b) -> Column:
    """Of arrays without repeats; two empty sets are alike."""
    common = F.size(F.array_intersect(col(a), col(b)))
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.try_divide(common.cast("double"), union.cast("double")))


# -- paths, with / and no . or .. inside


def dirname(path) -> Column:
    return F.regexp_replace(col(path), r"/?[^/]*$", "")


def basename(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def strip_extension(path) -> Column:
    """.d.ts is one extension."""
    return F.regexp_replace(col(path), r"(\.d\.(ts|mts|cts)|\.[A-Za-z0-9]+)$", "")


def stem(path) -> Column:
    return strip_extension(basename(path))


def within(path, folder) -> Column:
    """The folder or below it, at separators."""
    folder = F.regexp_replace(col(folder), "/+$", "")
    return (col(path) == folder) | col(path).startswith(F.concat(folder, F.lit("/")))


def normalise_path(path) -> Column:
    """Forward slashes, no empty or . segments, .. resolved as far as the path goes."""
    raw = F.translate(col(path), "\\", "/")
    parts = F.filter(F.split(raw, "/"), lambda x: (x != "") & (x != "."))

    def step(acc: Column, x: Column) -> Column:
        can = (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
        return F.when((x == "..") & can, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == "..") & raw.startswith("/"), acc).otherwise(F.array_append(acc, x))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(raw.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def common_length(a, b) -> Column:
    """How many leading elements two arrays share."""
    a, b = col(a), col(b)
    same = F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    first = F.array_position(same, False).cast("int")
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def relative_path(from_dir, to) -> Column:
    a = F.filter(F.split(col(from_dir), "/"), lambda x: x != "")
    b = F.filter(F.split(col(to), "/"), lambda x: x != "")
    n = common_length(a, b)
    ups = F.when(F.size(a) > n, F.array_repeat(F.lit(".."), F.size(a) - n)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(ups, F.slice(b, n + 1, F.greatest(F.size(b) - n, F.lit(0)))), "/")


def relative_specifier(importer, target, keep_extension: bool = False) -> Column:
    """How a file imports another: without extension or /index, and with a leading ./ or ../."""
    to = col(target) if keep_extension else F.regexp_replace(strip_extension(target), r"(^|/)index$", "")
    path = relative_path(dirname(importer), to)
    return F.when(path == "", ".").when(path.startswith("."), path).otherwise(F.concat(F.lit("./"), path))


def preferred_specifier(alias, relative, preference: str) -> Column:
    """alias, relative or shortest; of equal lengths the relative one is shortest."""
    alias, relative = col(alias), col(relative)
    if preference == "alias":
        return F.coalesce(alias, relative)
    if preference == "relative":
        return relative
    return F.when(alias.isNotNull() & (F.length(alias) < F.length(relative)), alias).otherwise(relative)


def package_of(specifier) -> Column:
    """@scope/name or name of a bare specifier; a scope alone is its own name."""
    s = col(specifier)
    return F.when(s.startswith("@"), F.regexp_extract(s, r"^(@[^/]*(?:/[^/]*)?)", 1)).otherwise(F.regexp_extract(s, r"^([^/]*)", 1))


def package_of_strict(specifier) -> Column:
    """The same, but a scope without a name is no package."""
    s = col(specifier)
    return F.when(s.rlike(r"^@[^/]*$"), F.lit(None).cast("string")).otherwise(package_of(s))


def glob_pattern(glob: str) -> str:
    """** spans folders, * and ? stay within one."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            c = glob[k]
            out, k = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+()[]{}^$|\\" else c), k + 1
    return f"^{out}$"


def matches_path(path, pattern: str) -> Column:
    """Equal, below it as a folder, or by glob if it has a wildcard."""
    if any(c in pattern for c in "*?"):
        return col(path).rlike(glob_pattern(pattern))
    return within(path, F.lit(pattern))


def matches_entrypoint(path, globs: list[str]) -> Column:
    """By the whole path, the base name, or any tail of the path that starts at a folder."""
    out = F.lit(False)
    for g in globs:
        out = out | col(path).rlike("(?:^|/)" + glob_pattern(g)[1:])
    return out


TEST_FILE = r"\.(test|spec)\.(c|m)?(j|t)sx?$|\.(test|spec)\.vue$"


def is_test(path) -> Column:
    return col(path).rlike(TEST_FILE)
