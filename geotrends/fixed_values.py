"""Names, thresholds, limits and paths that results depend on.

Everything here must keep exactly these values for the results to be right.
The code elsewhere only refers to them by name.
"""

# Selector meaning "do not filter on this key".
ALL = "All"

# Canonical state names, by the first word of the title-cased directory name.
CANONICAL_STATES = {
    "Andaman": "Andaman & Nicobar",
    "Jammu": "Jammu & Kashmir",
    "Dadra": "Dadra and Nagar Haveli and Daman and Diu",
}

# Units of the human-readable number text: strictly above the bound.
NUMBER_UNITS = [
    (1e12, "T"),
    (1e9, "B"),
    (1e7, "Cr"),
    (1e6, "M"),
    (1e3, "k"),
]

# Where each raw document set lives below the data root.
DOCUMENT_PATHS = {
    "aggregated_user": "aggregated/user/country/india",
    "aggregated_transaction": "aggregated/transaction/country/india",
    "aggregated_insurance": "aggregated/insurance/country/india",
    "map_user": "map/user/hover/country/india",
    "map_transaction": "map/transaction/hover/country/india",
    "map_insurance": "map/insurance/hover/country/india",
    "top_user": "top/user/country/india",
    "top_transaction": "top/transaction/country/india",
    "top_insurance": "top/insurance/country/india",
    "location": "map/insurance/country/india",
}

# Suffix taken off district names.
DISTRICT_SUFFIX = " District"

# Row limits of the top-place reports: (one of year / quarter open, otherwise).
STATE_LIMITS = (25, 15)
PLACE_LIMITS = (40, 15)

# Size of the high and low volume lists, and of the under-used brand list.
EDGE_ROWS = 10
UNDERUTILIZED_ROWS = 20

# Under-used brands: more users than, and app opens per user below.
UNDERUTILIZED_MIN_USERS = 5000
UNDERUTILIZED_MAX_RATE = 100

# Rising places: previous value below, and growth in percent above.
RISING_MAX_PREVIOUS = 10000
RISING_MIN_GROWTH = 100

# Year left out of the brand matrix.
BRAND_SKIPPED_YEAR = 2022

# Insurance growth years and the segment bounds, with the segment names.
GROWTH_YEAR = 2024
GROWTH_BASE_YEAR = 2023
SEGMENT_GROWTH = 20
SEGMENT_VOLUME = 100000
SEGMENTS = ["Best", "Saturated", "Rising", "Idle"]
SEGMENT_ROOT = "States by Category"

# Label of the whole-frame total, and the marker sizes on the user map.
GROSS = "Gross"
MARKER_SIZES = (5, 50)

# Quarters in order; the period put before the insurance trend.
QUARTERS = ["Q1", "Q2", "Q3", "Q4"]
FIRST_INSURANCE_PERIOD = (2020, "Q1", 0, 0.0)

# Rows per JDBC batch for the location tables.
LOCATION_BATCH_ROWS = 500
