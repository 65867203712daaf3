"""Text cleaning, tokens, word-set matching and structured responses, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common English function words left out of bags of words.
STOP_WORDS = (
    "the", "and", "for", "that", "this", "with", "from", "have", "has", "had", "was", "were", "are", "been", "but", "not", "you", "all", "any", "can", "her", "his", "its", "our", "out", "she", "they",
    "them", "then", "than", "there", "their", "what", "when", "where", "which", "who", "whom", "why", "how", "will", "would", "could", "should", "into", "over", "under", "after", "before", "while", "near", "about",
)

# Words that news titles carry whatever they report.
NEWS_WORDS = ("news", "live", "update", "updates", "breaking", "video", "photos", "report", "reports", "said", "says")

# Contractions and what they stand for, the longer endings first.
CONTRACTIONS = (("won't", "will not"), ("can't", "can not"), ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'m", " am"), ("it's", "it is"), ("that's", "that is"))


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def expand_contractions(text: Column) -> Column:
    out = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    for short, long in CONTRACTIONS:
        out = F.replace(out, F.lit(short), F.lit(long))
    return F.trim(out)


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{P}+]", "")


def clean_text(text: Column) -> Column:
    """Contractions written out, lower case, without punctuation and repeated blanks."""
    return collapse_blanks(strip_punctuation(expand_contractions(text)))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != "")


def singular(word: Column) -> Column:
    """Rule-based stand-in for noun lemmas: -ies, -sses, -ches, -shes, -xes and plain plurals."""
    plain = word.rlike(r"[^su]s$") & (F.length(word) > 3)
    return F.when(word.rlike("..ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(?:ss|ch|sh|x)es$"), F.regexp_replace(word, "es$", "")).when(plain, F.regexp_replace(word, "s$", "")).otherwise(word)


def topic_tokens(text: Column, stop_words: tuple[str, ...] = (*STOP_WORDS, *NEWS_WORDS)) -> Column:
    """Words that are no stop words and over two letters, then without digits and again over two, then singular."""
    kept = F.filter(words(text), lambda w: ~w.isin(*stop_words) & (F.length(w) > 2))
    bare = F.filter(F.transform(kept, lambda w: F.regexp_replace(w, r"\d+", "")), lambda w: F.length(w) > 2)
    return F.transform(bare, singular)


def token_estimate(text: Column) -> Column:
    """Words plus punctuation marks, an estimate of subword tokens."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))


def shares_partial_word(a: Column, b: Column, least: int = 1) -> Column:
    """Whether so many words of ``a`` contain or are contained in a word of ``b``; null text matches nothing."""
    left, right = (F.filter(F.split(F.replace(F.lower(x), F.lit("+"), F.lit(" ")), r"\s+"), lambda w: w != "") for x in (a, b))
    matching = F.filter(left, lambda x: F.exists(right, lambda y: F.contains(y, x) | F.contains(x, y)))
    return F.coalesce(F.size(matching) >= least, F.lit(False))


def soft_equal(found: Column, label: Column) -> Column:
    """1 where both are equal (also both null) or one contains the other, without regard to case; 0 where one is missing."""
    empty = (F.coalesce(found, F.lit("")) == "") | (F.coalesce(label, F.lit("")) == "")
    a, b = F.lower(found), F.lower(label)
    return F.when(found.eqNullSafe(label), 1).when(empty, 0).when(F.contains(a, b) | F.contains(b, a), 1).otherwise(0)


def title_case_share(text: Column) -> Column:
    tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.try_divide(F.size(F.filter(tokens, lambda w: w.rlike(r"^\p{Lu}"))).cast("double"), F.size(tokens))


LABEL_SCHEMA = "array<struct<event_occured:int,event:string,impact:int,dt:string,loc:string>>"


def strip_fences(response: Column) -> Column:
    return F.trim(F.regexp_replace(response, r"(?im)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def judged_responses(batches: DataFrame, response: str, items: str) -> DataFrame:
    """``batches`` plus parsed (array of labels) and failure: null, or why no label of the response can be used.

    'missing' is a null or blank response, 'malformed' one that is no JSON array of objects, 'wrong_length' one whose
    number of objects is not ``items``. A response counts as a whole, with or without a code fence around it.
    """
    bare = strip_fences(F.col(response))
    parsed = F.when(bare.startswith("[") & bare.endswith("]"), F.from_json(bare, LABEL_SCHEMA))
    judged = batches.withColumn("parsed", parsed)
    failure = F.when(F.coalesce(bare, F.lit("")) == "", "missing").when(F.col("parsed").isNull(), "malformed").when(F.size("parsed") != F.col(items), "wrong_length")
    return judged.withColumn("failure", failure)


def parse_label_response(batches: DataFrame, batch: str, response: str, items: str) -> DataFrame:
    """batch, position and the fields of each labelled item of a response.

    ``items`` is the number of articles asked for; a response that is no array of that many objects fails as a whole and
    is among the ``failed_responses``.
    """
    whole = judged_responses(batches, response, items).where("failure IS NULL")
    return whole.select(batch, F.posexplode("parsed").alias("position", "label")).select(batch, "position", "label.*")


def failed_responses(batches: DataFrame, batch: str, response: str, items: str) -> DataFrame:
    """batch, failure of the responses to ask for again."""
    return judged_responses(batches, response, items).where("failure IS NOT NULL").select(batch, "failure")


def prompt_block(title: Column, published: Column, content: Column) -> Column:
    return F.format_string("Title: %s\nPublish Date: %s\nContent: %s", F.coalesce(title, F.lit("")), F.coalesce(published, F.lit("")), F.coalesce(content, F.lit("")))


def main_text(html: Column) -> Column:
    """Text of a page's article element, or of the page: no scripts, styles, navigation or tags, entities resolved."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|header|footer|aside|noscript)\b.*?</\1>", " ")
    body = F.nullif(F.regexp_extract(bare, r"(?is)<article\b[^>]*>(.*?)</article>", 1), F.lit(""))
    text = F.regexp_replace(F.coalesce(body, bare), r"(?s)<[^>]+>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.nullif(collapse_blanks(text), F.lit(""))


def fetch_action(status: Column, attempt: Column, most_attempts: int = 5) -> Column:
    """What to do after a page request: store it, drop it, or try again after 2^attempt seconds."""
    again = F.when(attempt < most_attempts, F.concat(F.lit("retry_after_"), F.pow(F.lit(2), attempt).cast("int").cast("string"))).otherwise("drop")
    return F.when(status == 200, "store").when(status.isin(404, 410), "drop").when((status == 429) | status.isNull(), again).otherwise("drop")
