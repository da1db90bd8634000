"""Scalar text functions as Column expressions: query tokenisers, path parts, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of queries (fixed values).
SEARCH_STOP = ("how does what why when where which the and for that this with from into use uses used get set has have can will would should each some any are was were been being about work works all its not but they them their there").split()
LOOKUP_STOP = [*SEARCH_STOP, "is", "who", "do"]
KEYWORD_STOP = ("how does what why when where call calls the and for that this with from into use uses used get set has have can will would should which each some any").split()
# Verbs and the edge types they ask for (fixed values).
VERB_TYPES = {
    "call": "CALLS", "calls": "CALLS", "invoke": "CALLS", "invokes": "CALLS", "delegate": "CALLS", "delegates": "CALLS",
    "inherit": "INHERITS", "inherits": "INHERITS", "extend": "INHERITS", "extends": "INHERITS", "subclass": "INHERITS", "subclasses": "INHERITS",
    "import": "IMPORTS", "imports": "IMPORTS", "depend": "IMPORTS", "depends": "IMPORTS", "require": "IMPORTS", "requires": "IMPORTS",
    "raise": "RAISES", "raises": "RAISES", "throw": "RAISES", "throws": "RAISES", "decorate": "DECORATES", "decorates": "DECORATES", "define": "DEFINES", "defines": "DEFINES",
}
_SPLIT = r"""[\s,;:!?(){}\[\]"'`/\\]+"""


def _words(c: Column) -> Column:
    return F.filter(F.split(c, _SPLIT), lambda x: x != "")


def _kept(words: Column, stop: Sequence[str], least: int) -> Column:
    low = F.transform(words, lambda x: F.trim(F.lower(x)))
    return F.array_distinct(F.filter(low, lambda x: (F.length(x) >= least) & ~x.isin(*stop)))


def lookup_tokens(c: Column) -> Column:
    """Identifier tokens of a query: the dotted form first, then its parts; lower case, 2 characters or more, stop words out, first occurrence kept."""
    parts = F.transform(_words(c), lambda w: F.concat(F.when(w.contains("."), F.array(w)).otherwise(F.array().cast("array<string>")), F.split(w, r"[._]")))
    return _kept(F.flatten(parts), LOOKUP_STOP, 2)


def search_terms(c: Column, dotted: bool = True) -> Column:
    """Search terms: parts of 3 characters or more, then, if wanted, the dotted form."""
    whole = lambda w: F.when(w.contains(".") & F.lit(dotted), F.array(w)).otherwise(F.array().cast("array<string>"))
    parts = F.transform(_words(c), lambda w: F.concat(F.split(w, r"[._]"), whole(w)))
    return _kept(F.flatten(parts), SEARCH_STOP, 3)


def keyword_terms(c: Column) -> Column:
    """Identifier parts for keyword scores: cut at punctuation, dots and underscores, 3 characters or more, stop words out."""
    words = F.filter(F.split(c, r"""[\s.,;:!?(){}\[\]"'`/\\]+"""), lambda x: x != "")
    return _kept(F.flatten(F.transform(words, lambda w: F.split(w, "_"))), KEYWORD_STOP, 3)


def last_segment(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def file_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def path_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"^(.*)/[^/]*$", 1)


def depluralise(c: Column) -> Column:
    """Singular of a plain plural, or NULL where the word is none."""
    low, n = F.lower(c), F.length(c)
    return (
        F.when(low.endswith("ies") & (n > 4), F.concat(F.substring(c, F.lit(1), n - 3), F.lit("y")))
        .when((low.endswith("ses") | low.endswith("xes") | low.endswith("zes")) & (n > 3), F.substring(c, F.lit(1), n - 2))
        .when(low.endswith("s") & ~low.endswith("ss") & (n > 3), F.substring(c, F.lit(1), n - 1))
    )


def hue(c: Column) -> Column:
    """A colour angle from a name: the first 8 hex digits of its MD5, modulo 360."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % 360


def is_test_regex(path: Column) -> Column:
    """Test, benchmark and example paths, by a fixed pattern."""
    return path.rlike(r"(?i)[\\/](tests?|conftest|benchmarks|asv_benchmarks|examples)[\\/]|[\\/]test_[^\\/]*\.py$|_test\.py$")


def is_test_segment(path: Column) -> Column:
    """Test paths by their segments."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.split(F.regexp_replace(low, "/+$", ""), "/")
    name = F.element_at(parts, -1)
    return F.exists(parts, lambda x: x.isin("tests", "test") | x.startswith("test_")) | (~path.endswith("/") & (name.endswith("_test.py") | name.isin("conftest.py", "testing.py")))


def is_test_probe(path: Column) -> Column:
    """Test paths as a probe takes them: also testing folders and segments ending in _test."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    return F.exists(parts, lambda x: x.isin("tests", "test", "testing", "conftest.py") | x.startswith("test_") | x.endswith("_test") | x.endswith("_test.py"))


def md5_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, 16)


# Words left out of the seeds of a question (fixed values).
SEED_STOP = ("how does what why when where which the and for that this with from into use uses used get set has have can will would should each some any are was were been being about work works all its not but they them their there class method function module file code through between reach call calls").split()


def seed_terms(c: Column) -> Column:
    """Likely symbols of a question in their own case: dotted names and their parts, then CamelCase words, then all words cut at dots and underscores; each followed by its singular; 3 characters or more, first of each lower-cased form kept."""
    dotted = F.regexp_extract_all(c, F.lit(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+"), F.lit(0))
    dots = F.flatten(F.transform(dotted, lambda x: F.concat(F.array(x), F.split(x, r"\."))))
    camel = F.regexp_extract_all(c, F.lit(r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b"), F.lit(0))
    rest = F.transform(F.flatten(F.transform(_words(c), lambda w: F.split(w, r"[._]"))), F.trim)
    both = F.flatten(F.transform(F.concat(dots, camel, rest), lambda x: F.array(x, depluralise(x))))
    kept = F.filter(both, lambda x: x.isNotNull() & (F.length(x) >= 3) & ~F.lower(x).isin(*SEED_STOP))
    first = F.filter(kept, lambda x, i: F.array_position(F.transform(kept, F.lower), F.lower(x)) == i + 1)
    return first
