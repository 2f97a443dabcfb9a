"""Fixed values of the derived datasets.

These texts come from the data itself; results are only right with exactly these
spellings.
"""

# Code types and code prefixes.
PRODUCT = "NP"
SOURCE = "NS"
PRODUCT_PREFIX = "NP:"
SOURCE_PREFIX = "NS:"

# Suppliers, and the kinds of data whose snapshots the registry lists for them.
RCS = "S:RCS"
NEWS_ROOM = "S:NR"
RDS = "S:RDS"
FEEDS = "S:UCDP"
PACKAGES = "S:PS2"
ALL_DATA = "ALL"
PRODUCTS_DATA = "RDS_PRODUCTS"
PACKAGE_DATA = "PE_PDP"
LICENCE_DATA = "PE_PLI"
RULES_DATA = "MRN"
YES = "Y"
COMPLETED = "COMPLETED"

# Kind of reference -> table, label column, count column.
REFERENCES = {
    "COUNTRY": ("t_ref_country", "country", "country_count"),
    "REGION": ("t_ref_region", "region", "region_count"),
    "PUBLICATION": ("t_ref_publication_type", "publication_type", "pub_type_count"),
    "LANGUAGE": ("t_ref_language", "language", "language_count"),
    "INDUSTRY": ("t_ref_industry", "industry", "industry_count"),
}

# Kinds of facts about codes.
PERMISSION = "RUN_PE"
LANGUAGE = "LANGUAGE"
NO_PRODUCT = "IS_NOT_PROD_CODE"
NO_PRODUCT_FALSE = "N"
CLOSED_LICENCE = "EXCLUDE_FROM_EIKON"
CLOSED_LICENCE_FALSE = "false"
TRANSLATED_NAME = "TRANSLATEDNAME"
ENTITLEMENT = "ENTITLEMENT"
ENTITLEMENT_CODE = "PECODE"
NOT_AVAILABLE = ("N/A", "NA")
PERMISSION_SUFFIX = "M"
PLACEHOLDER_PRODUCT = "No Product Code"

# Output column of the permission search -> rule type, in join order.
RULE_TYPES = {
    "source_code": "PROVIDER",
    "lang_code": "LANGUAGE",
    "urgency": "URGENCY",
    "product_code": "AUDIENCE",
    "subject_code": "SUBJECT",
    "instance_code": "INSTANCE",
    "fullLanguage": "FULL_LANGUAGE",
}

# Content collections of source codes, and the sets they follow from.
HIGH_VALUE = "HV"
NEWS_WIRE = "NW"
WEB_NEWS = "WN"
NEWS_ROOM_COLLECTION = "NR"
WEB_NEWS_SET = "WEBNEWS"
NEWS_ROOM_SET = "NEWSROOM"
OWN_SET = "REFINITIV"
HIGH_VALUE_PRODUCT = "RFTHVS"
ACTIVE = "ACTIVE"
NO_DATA = "No Data"

# Packages and licences.
SPECIALIST = "Specialist"
FEE_LIABLE = "Fee Liable"
INCLUDED = "Included Where Indicated"
PACKAGE_STARTS = ("WWEIKON", "WWRFTW")
PACKAGE_OWNER = "LUCY CHAPLE"
RUNNING_LICENCE = "RRG"

# Separators of lists.
LIST = ", "
NAMES = "; "
VARIANTS = "|"
LANGUAGES = ","
CODE_AND_TEXT = " - "

# Report texts about feeds.
SOURCE_CODE_CHECK = "Source Code Check"
SOURCE_CODE_REASON = "No UCDP Source Code in RCS/RDS/NewsRoom"
FEED_CHECK = "Feed Check"
FEED_REASON = "Feed exists but not mapped to any Source Code"
