"""Column names, types and fixed lookup values of a posting."""

from __future__ import annotations

from pyspark.sql import types as T

POSTING = T.StructType(
    [
        T.StructField("key_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("post_date", T.DateType()),
        T.StructField("scrape_date", T.DateType()),
        T.StructField("description", T.StringType()),
        T.StructField("short_description", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("url", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("locale", T.StringType()),
        T.StructField("wage", T.StringType()),
        T.StructField("remoteness", T.StringType()),
    ]
)
POSTING_COLUMNS = POSTING.names

# One row of the block list or the duplicates list, without its key.
ENTRY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "company", "post_date", "description", "status")]
)

MATCH = T.StructType(
    [
        T.StructField("original_key_id", T.StringType()),
        T.StructField("duplicate_key_id", T.StringType()),
        T.StructField("dup_type", T.StringType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)

# One listing inside the JSON that a result page embeds.
LISTING_JSON = T.StructType(
    [
        T.StructField("displayTitle", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("formattedLocation", T.StringType()),
        T.StructField("jobkey", T.StringType()),
        T.StructField("formattedRelativeTime", T.StringType()),
        T.StructField("remoteLocation", T.BooleanType()),
        T.StructField(
            "taxonomyAttributes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("label", T.StringType()),
                        T.StructField(
                            "attributes",
                            T.ArrayType(T.StructType([T.StructField("label", T.StringType())])),
                        ),
                    ]
                )
            ),
        ),
        T.StructField(
            "extractedSalary",
            T.StructType(
                [
                    # Kept as text so that the amount is shown as the site wrote it.
                    T.StructField("min", T.StringType()),
                    T.StructField("max", T.StringType()),
                    T.StructField("type", T.StringType()),
                ]
            ),
        ),
    ]
)

# Why a rule rejects a posting, in the order of the rules.
REJECT_REASONS = ["status", "company", "age", "block list", "known duplicate", "remoteness"]

# ---- Fixed values -------------------------------------------------------------------------
# Header of the master CSV, in file order.
MASTER_CSV_COLUMNS = [
    "status", "title", "company", "location", "date", "blurb", "tags", "link", "id", "provider",
    "query", "locale", "wage", "remoteness",
]

STATUSES = [
    "UNKNOWN", "NEW", "ARCHIVE", "INTERVIEWING", "INTERVIEWED", "REJECTED", "ACCEPTED", "DELETE",
    "INTERESTED", "APPLIED", "APPLY", "OLD",
]
REMOVAL_STATUSES = ["DELETE", "ARCHIVE", "REJECTED", "OLD"]
LOCALES = [
    "CANADA_ENGLISH", "CANADA_FRENCH", "USA_ENGLISH", "UK_ENGLISH", "FRANCE_FRENCH", "GERMANY_GERMAN",
]
REMOTENESS = ["UNKNOWN", "IN_PERSON", "TEMPORARILY_REMOTE", "PARTIALLY_REMOTE", "FULLY_REMOTE", "ANY"]
PROVIDERS = ["INDEED", "GLASSDOOR", "MONSTER"]

KEY_ID, EXISTING_TFIDF, NEW_TFIDF = "KEY_ID", "EXISTING_TFIDF", "NEW_TFIDF"
DUPLICATE_TYPES = [KEY_ID, EXISTING_TFIDF, NEW_TFIDF]

DOMAIN_BY_LOCALE = {
    "CANADA_ENGLISH": "ca",
    "CANADA_FRENCH": "ca",
    "USA_ENGLISH": "com",
    "UK_ENGLISH": "co.uk",
    "FRANCE_FRENCH": "fr",
    "GERMANY_GERMAN": "de",
}
PAGE_SIZE = {"INDEED": 20, "GLASSDOOR": 30, "MONSTER": 25}

DEFAULT_RADIUS = 25
DEFAULT_MAX_LISTING_DAYS = 60
MIN_DESCRIPTION_CHARS = 5
MIN_SIMILARITY_CORPUS = 25
SIMILARITY_THRESHOLD = 0.75
# ---- End of fixed values ------------------------------------------------------------------
