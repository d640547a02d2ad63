"""Thresholds, vocabularies and lookup tables.

Everything here is a default: each operator takes the value as a keyword argument.
"""

from __future__ import annotations

# --- Fixed values: thresholds the results depend on ---------------------------------
BENCHMARK_MARGIN = 0.05
MIN_REVIEWS_FOR_FLAG = 10
BOOTSTRAP_SAMPLES = 2000
CI_LEVEL = 0.95
FDR_Q = 0.05
CHANGEPOINT_MIN_EFFECT = 0.4
CHANGEPOINT_MIN_MONTHS = 4
CHANGEPOINT_MIN_UNITS = 10
MARKET_WIDE_FRACTION = 0.6
MARKET_MIN_EFFECT = 0.3
MIN_PROPERTIES_FOR_SCOPE = 3
SEASONAL_MIN_YEARS = 2
SEASONAL_MIN_MONTH_UNITS = 2
SEASONAL_MIN_REST_UNITS = 5
STEP_MIN_SIDE_UNITS = 5
ALPHA = 0.05
MIN_UNITS_PER_SIDE = 10
POWER_Z = 2.8016
TIMING_MIN_MONTHS = 2
NEIGHBOURHOOD_RADIUS_KM = 1.0
NEIGHBOURHOOD_MIN_PROPERTIES = 3
NEIGHBOURHOOD_MAX_SHARE = 0.5
NEIGHBOURHOOD_MAX_P = 0.05
NEIGHBOURHOOD_PERMUTATIONS = 499
NEIGHBOURHOOD_SEED = 0
EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = 111.2
PUBLIC_GRID_KM = 0.5
POST_NEGATION_WINDOW = 2
NEGATION_SPAN = 3
CHAR_NGRAMS = (2, 5)
RATING_RANGE = (1.0, 5.0)
LOCAL_TZ = "Asia/Kolkata"
TEXT_LIMIT = 2000
MODEL_MIN_DF = 3
MODEL_MAX_FEATURES = 60_000
MODEL_C_GRID = (0.5, 1.0, 2.0, 4.0)
FOCUS_TOWN_MIN_REVIEWS = 1000

# --- Fixed values: review schema -----------------------------------------------------
REQUIRED_COLUMNS = ["property_id", "platform", "date", "rating", "text", "language_hint"]
OPTIONAL_COLUMNS = ["review_id"]
IDENTITY_COLUMNS = {
    "reviewer_name", "reviewer_id", "reviewer", "user", "username", "user_id",
    "author", "name", "email", "phone", "profile_url",
}
COLUMN_ALIASES = {
    "property_id": ("property_id", "property", "hotel_id", "hotel", "listing_id"),
    "platform": ("platform", "source", "channel", "site"),
    "date": ("date", "review_date", "created_at", "published_at"),
    "rating": ("rating", "stars", "score", "review_rating"),
    "text": ("text", "review_text", "review", "comment", "content"),
    "language_hint": ("language_hint", "language", "lang"),
}
LOCATION_ALIASES = {
    "property_id": ("property_id", "property", "hotel_id", "hotel", "listing_id"),
    "lat": ("lat", "latitude", "y"),
    "lon": ("lon", "lng", "long", "longitude", "x"),
    "zone": ("zone", "area", "neighbourhood", "neighborhood", "locality"),
}

# --- Fixed values: text tables -------------------------------------------------------
EMOJI_WORDS = {
    "\U0001f60a": " good ",
    "\U0001f600": " good ",
    "\U0001f44d": " good ",
    "❤": " good ",
    "\U0001f620": " bad ",
    "\U0001f621": " bad ",
    "\U0001f44e": " bad ",
    "\U0001f922": " bad ",
}
EMOJI_RANGES = ((0x1F300, 0x1FAFF), (0x2600, 0x27BF), (0x1F1E6, 0x1F1FF))
SPELLING = {
    "nhi": "nahi",
    "bht": "bahut",
    "bohot": "bahut",
    "gnda": "ganda",
    "acha": "accha",
    "achha": "accha",
    "achi": "accha",
    "achhi": "accha",
    "acchi": "accha",
    "achhe": "accha",
    "acche": "accha",
    "nahin": "nahi",
    "saaf-safai": "saaf safai",
}
CONTRAST_WORDS = (
    "but", "however", "although", "though", "whereas",
    "lekin", "magar", "jabki", "kintu", "parantu",
    "लेकिन", "मगर", "जबकि", "किंतु", "परंतु",
)
JOINING_WORDS = ("or", "aur")
HINGLISH_MARKERS = (
    "khaana", "khana", "kamra", "accha", "acha", "bahut", "nahi",
    "saaf", "ganda", "mehenga", "paisa", "badhiya", "thanda",
)

# --- Fixed values: aspect taxonomy (order is output order) ---------------------------
ASPECTS = {
    "Food": [
        "food", "khaana", "khana", "breakfast", "nashta", "dinner", "lunch", "meal", "thali",
        "swaad", "taste", "menu", "restaurant", "खाना", "नाश्ता",
    ],
    "Room": [
        "room", "kamra", "kamre", "bed", "bistar", "heater", "heating", "geyser", "blanket",
        "kambal", "hot water", "garam paani", "कमरा", "हीटर",
    ],
    "Housekeeping": [
        "housekeeping", "towel", "towels", "room service", "bedsheet", "chadar",
        "change the sheets", "laundry",
    ],
    "Staff": [
        "staff", "reception", "receptionist", "manager", "behaviour", "behavior", "vyavhaar",
        "caretaker", "स्टाफ",
    ],
    "Location": [
        "location", "view", "nazara", "nazaara", "scenery", "mountain", "pahad", "market",
        "jagah", "locality", "नज़ारा",
    ],
    "Value for Money": [
        "value", "price", "paisa", "paisa vasool", "expensive", "mehenga", "mehnga", "costly",
        "cheap", "sasta", "worth", "overpriced", "tariff",
    ],
    "Cleanliness": [
        "clean", "cleanliness", "saaf", "safai", "saaf-safai", "dirty", "ganda", "gandagi",
        "hygiene", "bathroom", "washroom", "गंदा", "साफ",
    ],
    "Booking Experience": [
        "booking", "check-in", "checkin", "check in", "checkout", "reservation", "booked",
        "refund", "payment process",
    ],
}

# --- Fixed values: sentiment lexicon -------------------------------------------------
LEXICON = {
    "positive": [
        "accha", "amazing", "awesome", "badhiya", "beautiful", "best", "clean", "comfortable",
        "cozy", "delicious", "excellent", "fresh", "friendly", "good", "great", "helpful",
        "khush", "lovely", "mast", "nice", "perfect", "polite", "saaf", "sasta", "shandar",
        "spacious", "swadisht", "tasty", "warm", "wonderful", "zabardast",
        "अच्छा", "बढ़िया", "शानदार", "साफ", "साफ़", "सुंदर",
    ],
    "negative": [
        "awful", "bad", "bekaar", "broken", "cold", "dirty", "disappointed", "disappointing",
        "expensive", "ganda", "gandagi", "kharaab", "kharab", "leaking", "mehenga", "mehnga",
        "noisy", "overpriced", "pathetic", "poor", "problem", "rude", "slow", "smelly",
        "stale", "terrible", "thanda", "unhelpful", "worst",
        "खराब", "गंदगी", "गंदा", "ठंडा", "बेकार", "महंगा",
    ],
    "positive_phrases": ["paisa vasool", "value for money", "well maintained"],
    "negative_phrases": [
        "not working", "did not work", "didn't work", "no hot water", "not clean",
        "kaam nahi", "nahi chal", "band tha", "kaam nahi kar",
    ],
    "negation": ["bina", "never", "no", "not", "without"],
    "post_negation": ["nahi", "नहीं", "नही"],
}

# --- Fixed values: hill-region file names --------------------------------------------
REGION_STATES = {
    "Uttarakhand": "Uttarakhand",
    "Himachal_Pradesh": "Himachal Pradesh",
    "Ladakh_Jammu_and_Kashmir": "Ladakh",
    "Jammu_and_Kashmir": "Jammu and Kashmir",
}
REGION_DISTRICTS = [
    "Almora", "Bageshwar", "Chamoli", "Champawat", "Dehradun", "Haridwar", "Nainital",
    "Pauri_Garhwal", "Pithoragarh", "Rudraprayag", "Tehri_Garhwal", "Udham_Singh_Nagar",
    "Uttarkashi",
    "Bilaspur", "Chamba", "Hamirpur", "Kangra", "Kinnaur", "Kullu", "Lahaul_and_Spiti",
    "Lahaul_Spiti", "Mandi", "Shimla", "Sirmaur", "Solan", "Una",
    "Leh", "Kargil",
]
PLAINS_DISTRICTS = ["Haridwar", "Udham Singh Nagar"]

MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June", "July", "August",
    "September", "October", "November", "December",
]

# --- sentences: {names} are filled in by the operators ------------------------------------------

CHECK_SENTENCES = {
    "better": "{aspect} got better.",
    "worse": "{aspect} got worse.",
    "unclear": "No change of {aspect} stands out: one of less than {mde} could go unseen here.",
    "levels": "Mean sentiment: {before} between {baseline} and {start}, {after} afterwards.",
    "market": "Net of other properties ({market}) this is {effect}, with 95% confidence {low} to {high}.",
    "alone": "Other properties have too little to say about it, so their trend is not taken out.",
    "placebo": "By size this is number {rank} of {compared} properties tested in the same way.",
    "early": "Caution: a break is already visible at {detected}, ahead of {start}; look for another cause.",
    "few_before": "{aspect} has {n_before} reviews ahead of {start}; a comparison takes {needed}.",
    "few_after": "{aspect} has {n_after} reviews from {start} on; a comparison takes {needed}.",
    "absent": "{property} has no review about {aspect}.",
}

OWNER_SENTENCES = {
    "few": "{k} reviewed: not enough to tell a property from its market",
    "no_pattern": "lags, while {aspect} shows no pattern that others share",
    "fell": "moved {fell} against the market in {month}, when the market's own move was {market}",
    "also": "{told} is common to the market",
    "scarce": "hardly any reviews {where}, so the shared pattern can't be set aside",
    "still": "{gap} under the market even {where}; {also}",
    "shared": "{patterns}; no lag {where} ({drops})",
    "drops": "own dip {mine}, mean dip {all}",
    "near": "{aspect}: {n} properties no more than {radius} km away ({names}) went down together in "
            "{month}; own move {own}, group {group} net of the market, permutation p {p}",
}

PRIORITY_SENTENCES = {
    "rationale": "{aspect}: {now} against {reference} ({compared}{since}), a gap of {gap}; {because}. "
                 "{share}% of all mentions.",
    "own": "the property's own reviews break downwards, and too few others review {aspect}",
    "decline": "a break downwards that the market does not share",
    "near": "a break downwards that the neighbours share",
    "lag": "95% interval {low} to {high} of the difference, below zero after false-discovery control",
}
