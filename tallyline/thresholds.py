"""Fixed limits of the reconciliation rules. Values that results depend on."""

CANDIDATE_DAYS_BEFORE = 3
CANDIDATE_DAYS_AFTER = 10
CANDIDATE_FETCH_CAP = 200
CANDIDATES_SHOWN = 5
AUTO_MATCH_DATE_DAYS = 3
DUPLICATE_MIN_AGREEING_FIELDS = 2
DUPLICATE_DATE_DAYS = 2
SEARCH_WINDOW_DAYS = 7
MAX_MESSAGES_FETCHED = 5
RESULTS_PER_PASS = 25
BATCH_SIZE = 20
MAX_CONTINUATION_DISTANCE = 2

#: Currencies and their exponents.
CURRENCIES = {
    "INR": 2, "USD": 2, "EUR": 2, "GBP": 2, "AED": 2, "SGD": 2, "AUD": 2, "CAD": 2,
    "CHF": 2, "HKD": 2, "SAR": 2, "MYR": 2, "LKR": 2, "JPY": 0, "KWD": 3, "BHD": 3,
}
