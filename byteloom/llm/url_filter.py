"""URL filter by a weighted vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in a lower-cased URL in one pass. An occurrence counts if it
is bounded on both sides: the neighbouring characters, if any, are no ASCII letters or digits. A URL is rejected on one
strict term, or on ``MIN_SOFT`` different soft terms; repeats of a soft term count once towards that. score is the weight
of the different terms found. The vocabulary is a parameter.

Defined cases. A null or empty URL has no hits and isn't rejected. Repeated rows are judged alike and all listed. A null
page_id is kept. A term that is another one's part, or its repeat, has no ties: only whole bounded terms count. An empty table
has no rows. Further columns are ignored, whatever their names. However long a URL is, all of it is searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SOFT = 2


def _terms(weights: dict[int, str]) -> dict[str, int]:
    return {term: weight for weight, terms in weights.items() for term in terms.split()}


#: Terms of lower-case letters and digits, with their weights. One strict term rejects a URL: words that hardly stand in
#: other URLs. Soft terms - of adult, gambling, drug-selling, loan, piracy, tracking and link-farm sites, as the categories of
#: public blocklists name them - stand in others too; parameters of ordinary URLs, such as "ref" or "feed", are none of them.
STRICT = _terms(
    {
        10: "porn porno porns pornhub pornstar pornstars xxx hentai xvideos xhamster xnxx redtube youporn spankbang beeg brazzers bangbros",
        9: "blowjob blowjobs handjob creampie gangbang bukkake cumshot cumshots deepthroat threesome milf milfs upskirt camwhores",
        8: "escorts callgirls camgirls camgirl sexcam sexcams livesex sexchat chaturbate cam4 livejasmin bongacams stripchat adultfriendfinder",
        7: "casinobonus onlinecasino casinoonline sportsbetting bookmaker viagra cialis levitra kamagra tadalafil sildenafil tramadol xanax",
        6: "warez keygen keygens crackz serialz nulled moviez spamfarm linkfarm hacktool paydayloan paydayloans",
    }
)
SOFT = _terms(
    {
        4: "nude nudes naked erotic erotica fetish bdsm orgasm sexy sex escort stripper strippers lingerie swingers hookup hookups",
        3: "adult adults nsfw casino casinos jackpot roulette blackjack baccarat pokies spam scam phishing malware botnet darknet",
        2: """poker betting bets bet slots slot lottery lotto gambling gamble bookie bookies odds sportsbook bingo payday loan loans torrent torrents
            crack cracks cracked pirate pirated pirates serials dating singles pill pills pharmacy pharma rx meds diet steroids viagras
            replica replicas rolex counterfeit seo backlink backlinks popup popups popunder adserver adservers doubleclick clickbait tracker trackers""",
        1: """ads ad adv advert adverts banner banners track tracking click clicks sponsor sponsored promo promos coupon coupons affiliate affiliates
            cheap free win winner winners bonus prize prizes giveaway cash credit debt insurance mortgage refinance farm farms links
            cams cam webcam webcams girls babes teens hot wild mature amateur live chat stream streams streaming downloads hack hacks cheats""",
    }
)


@lru_cache(8)
def automaton(strict: tuple[tuple[str, int], ...], soft: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for terms, is_strict in ((soft, False), (strict, True)):
        for term, weight in terms:
            if not (term.isascii() and term.isalnum() and term == term.lower()):
                raise ValueError(f"a term has lower-case ASCII letters and digits only: {term!r}")
            if term in out:
                raise ValueError(f"a term is strict or soft: {term!r}")
            out.add_word(term, (term, weight, is_strict))
    out.make_automaton()
    return out


def _free(url: str, at: int) -> bool:
    return not (0 <= at < len(url)) or not ("a" <= url[at] <= "z" or "0" <= url[at] <= "9")


def hits(url: str | None, a: ahocorasick.Automaton) -> tuple[int, int, int, int]:
    """Strict and soft occurrences in a lower-cased URL, different soft terms, weight of the different terms."""
    strict, soft, seen, score = 0, 0, set(), 0
    for end, (term, weight, is_strict) in a.iter(url or ""):
        if _free(url, end + 1) and _free(url, end - len(term)):
            strict, soft = strict + is_strict, soft + (not is_strict)
            if (term, is_strict) not in seen:
                seen.add((term, is_strict))
                score += weight
    return strict, soft, sum(not s for _, s in seen), score


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", strict: dict[str, int] = STRICT, soft: dict[str, int] = SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """page_id, url, strict_hits, soft_hits, distinct_soft, score, rejected."""
    terms = tuple(strict.items()), tuple(soft.items())
    found = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), F.lower(pages[url_col]).alias("low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(*terms)
        for b in batches:
            rows = [hits(u, a) for u in b.column(2).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            rejected = pa.array([r[0] > 0 or r[2] >= min_soft for r in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, rejected], ["page_id", "url", "strict_hits", "soft_hits", "distinct_soft", "score", "rejected"])

    schema = f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, strict_hits long, soft_hits long, distinct_soft long, score long, rejected boolean"
    return found.mapInArrow(run, schema)


def sql(strict: dict[str, int] = STRICT, soft: dict[str, int] = SOFT, min_soft: int = MIN_SOFT) -> str:
    """The same rows in DuckDB's SQL, from pages (page_id, url): bounded terms are runs of letters and digits."""

    def listed(terms: dict[str, int]) -> str:
        return "[" + ", ".join(f"'{t}'" for t in terms) + "]::varchar[]"

    weights = "map {" + ", ".join(f"'{t}': {w}" for t, w in (strict | soft).items()) + "}"
    return f"""
    select page_id, url, strict_hits, soft_hits, distinct_soft, score, strict_hits > 0 or distinct_soft >= {min_soft} as rejected from (
      select page_id, url, len(a) as strict_hits, len(b) as soft_hits, len(list_distinct(b)) as distinct_soft,
             coalesce(list_sum(list_transform(list_distinct(a || b), lambda x: weights[x])), 0)::bigint as score
      from (select page_id, url, list_filter(words, lambda x: list_contains({listed(strict)}, x)) as a, list_filter(words, lambda x: list_contains({listed(soft)}, x)) as b, {weights} as weights
            from (select page_id, url, string_split_regex(lower(coalesce(url, '')), '[^a-z0-9]+') as words from pages)))
    """
