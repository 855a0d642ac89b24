"""Values that results depend on: patterns, word lists, code tables and category orders.

Every function takes them as parameters; these are the defaults.
"""

# --- fixed values: text patterns -------------------------------------------------------------------
KEYWORD = "trump"
QUOTE_LINE = r"(?m)^[ \t]*(?:&gt;|>).*$"
MARKDOWN_LINK = r"\[([^\]]*)\]\((?:https?://|/)[^)]*\)"
URL = r"(?:https?://|www\.)\S+"
JUNK_TITLE = r"^\W*(?:\[\s*removed by moderator\s*\]|I_(?:do_not_)?support_trump)\W*$"
ZERO_WIDTH_SPACE = "\u200b"
ID_PREFIX = r"^t[13]_"
POST_PREFIX = "t3_"
COMMENT_PREFIX = "t1_"

# --- fixed values: placeholders and accounts -------------------------------------------------------
DELETED = "[deleted]"
REMOVED = "[removed]"
PSEUDO_MISSING = ["", "nan", "None", "NaN", "[deleted]", "[removed]"]
FALSE_LIKE = ["False", "false", "0", "0.0"]
TRUE_LIKE = ["True", "true", "1", "1.0"]
BOT_AUTHORS = [
    "AutoModerator", "PoliticsModeratorBot", "autotldr", "AskTrumpSupporters-ModTeam",
    "sneakpeekbot", "tweettranscriberbot", "TotesMessenger", "FatFingerHelperBot",
    "video_descriptionbot", "WikiTextBot", "youtubefactsbot", "Mentioned_Videos", "SmallSubBot",
]

# --- fixed values: time windows and declared stance ------------------------------------------------
PERIODS = {"2017": "T1_Y1", "2018": "T1_Y2", "2025": "T2_Y1", "2026": "T2_Y2"}
STUDY_MONTHS = (1, 6)
SECOND_ERA_FROM = 2025
FLAIR_COMMUNITY = "AskTrumpSupporters"
FLAIR_STANCE = {
    "nimble navigator": "supporter",
    "trump supporter": "supporter",
    "non-trump supporter": "nonsupporter",
    "nonsupporter": "nonsupporter",
    "undecided": "undecided",
}

# --- fixed values: kept columns --------------------------------------------------------------------
SUBMISSION_COLUMNS = [
    "id", "created_utc", "source_month", "subreddit", "author", "author_flair_text",
    "title", "selftext", "is_self", "domain", "url", "link_flair_text",
    "score", "num_comments", "upvote_ratio", "removed_by_category", "distinguished", "stickied",
    "submission_mentions_trump", "has_trump_comment",
]
COMMENT_COLUMNS = [
    "id", "submission_id", "parent_id", "created_utc", "source_month",
    "subreddit", "author", "author_flair_text", "body",
    "score", "controversiality", "distinguished", "stickied", "edited",
]

# --- fixed values: labels, thresholds, sampling ----------------------------------------------------
CLASSES = ["against", "neutral", "pro"]
TONE_THRESHOLD = 0.05
MIN_WORDS, MAX_WORDS = 5, 250
TEXT_MAX_CHARS = 4000
CONTEXT_MAX_CHARS = 1000
SEED = 42
N_BOOT = 2000
N_FOLDS = 10
TOKEN_LIMITS = [192, 256, 384, 512]
NO_ANSWER = "error"

# --- fixed values: survey codes --------------------------------------------------------------------
APPROVAL = {1: "approve", 2: "disapprove", 9: "dk", 99: "dk"}
STRENGTH = {1: "very_strongly", 2: "not_so_strongly", 9: "dk", 99: "dk"}
PARTY = {1: "rep_lean", 2: "dem_lean", 9: "other_dk"}
IDEOLOGY = {1: "very_conservative", 2: "conservative", 3: "moderate", 4: "liberal", 5: "very_liberal"}
GENDER_PHONE = {1: "man", 2: "woman"}
GENDER_PANEL = {1: "man", 2: "woman", 3: "other"}
AGE_CATEGORY = {1: "18-29", 2: "30-49", 3: "50-64", 4: "65+"}
EDUCATION_PANEL = {1: "college_grad_plus", 2: "some_college", 3: "hs_or_less"}
PANEL_MODE = {1: "atp_web", 2: "atp_phone"}
# upper bounds are inclusive; None closes the last group
AGE_GROUPS = [(29, "18-29"), (49, "30-49"), (64, "50-64"), (None, "65+")]
AGE_REFUSED_FROM = 99
EDUCATION_GROUPS = [(3, "hs_or_less"), (5, "some_college"), (None, "college_grad_plus")]
EDUCATION_REFUSED_FROM = 9
MAX_FIELD_DAYS = 21

# --- fixed values: survey waves (raw variable of each role) ----------------------------------------
WAVES = [
    {"wave_id": "Feb17", "family": "phone_rdd", "id": "psraid", "weight": "weight", "approval": "q1",
     "strength": "q1a", "date": "int_date", "date_format": "mddyy", "party": "partysum",
     "ideology": "ideo", "gender": "sex", "age": "age", "education": "educ2"},
    {"wave_id": "Apr17", "family": "phone_rdd", "id": "psraid", "weight": "weight", "approval": "q1",
     "strength": "q1a", "date": "int_date", "date_format": "mddyy", "party": "partysum",
     "ideology": "ideo", "gender": "sex", "age": "age", "education": "educ2"},
    {"wave_id": "Typology17", "family": "phone_rdd", "id": "mergeid", "weight": "weight",
     "approval": "qa1", "strength": "qa1a", "asked": "qa1", "date": "int_date",
     "date_format": "mddyy", "party": "partysum", "ideology": "ideo", "gender": "sex",
     "age": "age", "education": "educ2"},
    {"wave_id": "Jan18", "family": "phone_rdd", "id": "respid", "weight": "weight", "approval": "q2",
     "strength": "q2a", "date": "int_date", "date_format": "yymmdd", "party": "partysum",
     "ideology": "ideo", "gender": "sex", "age": "age", "education": "educ"},
    {"wave_id": "Mar18", "family": "phone_rdd", "id": "masterid", "weight": "weight",
     "approval": "q2", "strength": None, "date": "ftcalldt", "date_format": "date",
     "party": "partysum", "ideology": "ideo", "gender": "sex", "age": "age", "education": "educ"},
    {"wave_id": "May18", "family": "phone_rdd", "id": "respid", "weight": "weight", "approval": "q2",
     "strength": "q2a", "date": "int_date", "date_format": "yymmdd", "party": "partysum",
     "ideology": "ideo", "gender": "sex", "age": "age", "education": "educ"},
    {"wave_id": "Jun18", "family": "phone_rdd", "id": "respid", "weight": "weight", "approval": "q2",
     "strength": None, "date": "int_date", "date_format": "yymmdd", "party": "partysum",
     "ideology": "ideo", "gender": "sex", "age": "age", "education": "educ"},
    {"wave_id": "W161", "family": "atp", "id": "QKEY", "weight": "WEIGHT_W161",
     "approval": "POL1DT_W161", "strength": "POL1DTSTR_W161", "date": "INTERVIEW_START_W161",
     "date_format": "atp", "party": "F_PARTYSUM_FINAL", "ideology": "F_IDEO", "gender": "F_GENDER",
     "age_category": "F_AGECAT", "education_category": "F_EDUCCAT", "mode": "SVYMODE_W161"},
    {"wave_id": "W167", "family": "atp", "id": "QKEY", "weight": "WEIGHT_W167",
     "approval": "POL1DT_W167", "strength": "POL1DTSTR_W167", "date": "INTERVIEW_START_W167",
     "date_format": "atp", "party": "F_PARTYSUM_FINAL", "ideology": "F_IDEO", "gender": "F_GENDER",
     "age_category": "F_AGECAT", "education_category": "F_EDUCCAT", "mode": "SVYMODE_W167"},
]

# --- fixed values: poll sheets ---------------------------------------------------------------------
POLL_GROUPS = {
    "US Registered Voters": "overall",
    "Under 30": "age", "30-44": "age", "45-64": "age", "65+": "age",
    "Male": "gender", "Female": "gender",
    "White": "race_ethnicity", "Black": "race_ethnicity", "Hispanic": "race_ethnicity",
    "Other": "race_ethnicity",
    "HS or less": "education", "Some college": "education", "College grad": "education",
    "Postgrad": "education",
    "Democrat": "party", "Independent": "party", "Republican": "party",
}
SHARE_TOLERANCE = 0.010001
