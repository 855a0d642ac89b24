"""Registry of queries and the SQL text used by their checks."""

from __future__ import annotations

from forumlens.session import configure

KEYWORD = "the"      # keyword of the test tables
COMMUNITY = "ask"    # community of the test tables whose flair is a declared stance


class Book:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        """Register a function of (session, folder) under a name, with the SQL it has to agree with."""
        def register(function):
            def run(spark, sf_dir):
                configure(spark)
                return function(spark, sf_dir)
            run.__name__, run.__doc__ = name, function.__doc__
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return function
        return register


# --- SQL text shared by the checks -----------------------------------------------------------------
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
NOT_WS = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
NOT_W = r"[^\p{L}\p{N}_]"
LF = "chr(10)"


def sql_mentions(column: str, keyword: str = KEYWORD) -> str:
    return rf"coalesce(regexp_matches({column}, '(?i)(^|{NOT_W}){keyword}({NOT_W}|$)'), false)"


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, '^{WS}+|{WS}+$', '', 'g')"


def sql_no_quotes(column: str) -> str:
    return rf"regexp_replace({column}, '(?m)^[ \t]*(&gt;|>).*$', '', 'g')"


def sql_link_text(column: str) -> str:
    return rf"regexp_replace({column}, '\[([^\]]*)\]\((https?://|/)[^)]*\)', '\1', 'g')"


def sql_no_urls(column: str) -> str:
    return rf"regexp_replace({column}, '(https?://|www\.){NOT_WS}+', '', 'g')"


def sql_entities(column: str) -> str:
    for name, value in [("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")]:
        column = f"replace({column}, '{name}', {value})"
    return column


def sql_no_zero_width(column: str) -> str:
    return f"replace({column}, chr(8203), '')"


def sql_collapse(column: str) -> str:
    blanks = rf"regexp_replace({column}, '[ \t]+', ' ', 'g')"
    return sql_strip(f"regexp_replace({blanks}, '{WS}*\\n{WS}*', {LF}, 'g')")


def sql_clean(column: str) -> str:
    text = sql_no_urls(sql_link_text(sql_no_quotes(f"coalesce({column}, '')")))
    return sql_collapse(sql_no_zero_width(sql_entities(text)))


def sql_words(column: str) -> str:
    return f"CAST(len(regexp_extract_all({column}, '{NOT_WS}+')) AS INTEGER)"


SQL_BOT = ("(coalesce(distinguished = 'moderator', false) OR coalesce(author IN ('AutoModerator', "
           "'PoliticsModeratorBot', 'autotldr', 'AskTrumpSupporters-ModTeam', 'sneakpeekbot', 'tweettranscriberbot', "
           "'TotesMessenger', 'FatFingerHelperBot', 'video_descriptionbot', 'WikiTextBot', 'youtubefactsbot', "
           "'Mentioned_Videos', 'SmallSubBot'), false))")
SQL_PERIOD = ("CASE substr(source_month, 1, 4) WHEN '2017' THEN 'T1_Y1' WHEN '2018' THEN 'T1_Y2' "
              "WHEN '2025' THEN 'T2_Y1' WHEN '2026' THEN 'T2_Y2' END")
SQL_FLAIR = "nullif(trim(author_flair_text), '')"
SQL_STANCE = (f"CASE WHEN subreddit = '{COMMUNITY}' AND {SQL_FLAIR} IS NOT NULL THEN CASE lower({SQL_FLAIR}) "
              "WHEN 'nimble navigator' THEN 'supporter' WHEN 'trump supporter' THEN 'supporter' "
              "WHEN 'non-trump supporter' THEN 'nonsupporter' WHEN 'nonsupporter' THEN 'nonsupporter' "
              "WHEN 'undecided' THEN 'undecided' ELSE 'other' END END")
SQL_JUNK = (rf"coalesce(regexp_matches(title, '(?i)^{NOT_W}*(\[{WS}*removed by moderator{WS}*\]|"
            rf"I_(do_not_)?support_trump){NOT_W}*$'), false)")
