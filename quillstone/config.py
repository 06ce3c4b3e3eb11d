"""Settings and fixed values.

The tuples below are fixed values: results are only right if they are exactly these.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.45
    trees: int = 150
    learning_rate: float = 0.05
    depth: int = 3
    leaf: int = 2
    seed: int = 42
    jpeg_quality: int = 90
    max_regions: int = 6
    ocr_config: str = "--psm 6"
    min_width: int = 300


DEFAULT = Settings()
FIELDS = ("vendor", "date", "total")

# Terms that raise or lower a line's standing as the total.
POSITIVE_TERMS = ("grand total", "total due", "amount due", "net total", "net amount", "balance due", "pay", "payment", "total")
NEGATIVE_TERMS = (
    "subtotal", "sub total", "tax", "vat", "gst", "sst", "service", "tip", "cash", "change", "card", "visa", "master", "rounding",
    "discount", "tendered", "quantity", "qty", "item", "no.", "number", "tel", "phone", "fax", "date",
)
SUBTOTAL_TERMS = ("subtotal", "sub total")
TAX_TERMS = ("tax", "vat", "gst", "sst", "service")
QUANTITY_STARTS = ("qty", "quantity", "item", "no.", "number")
# Terms that a vendor's line doesn't hold, and stop words of the alternative vendor rule.
VENDOR_STOPS = ("receipt", "invoice", "tax invoice", "cashier", "tel", "phone", "date", "time", "total", "subtotal", "change", "cash")
VENDOR_STOP_WORDS = (
    "receipt", "invoice", "tax", "date", "time", "cashier", "total", "subtotal", "change", "cash", "card", "visa", "master", "thank",
    "tel", "phone", "fax", "address", "no.", "gst", "sst",
)
# What surrounds dates, and the shapes and formats of dates in the order they are tried.
DATE_TERMS = ("date", "issued", "invoice", "txn", "transaction", "receipt date", "printed", "time")
DATE_STRONG_TERMS = ("receipt date", "transaction", "txn")
MONTH_STEM = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
DATE_SHAPES = (
    r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b",
    r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b",
    r"\b\d{1,2}\.\d{1,2}\.\d{2,4}\b",
    rf"\b{MONTH_STEM}\.?\s+\d{{1,2}},?\s+\d{{2,4}}\b",
    rf"\b\d{{1,2}}\s+{MONTH_STEM}\.?\s+\d{{2,4}}\b",
)
#: What every text has that one of the shapes fits.
DATE_SIGN = rf"(?i)\d[-/]\d{{1,2}}[-/]\d|\d\.\d{{1,2}}\.\d|{MONTH_STEM}\.?\s+\d"
DATE_FORMATS = (
    "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%m-%d-%Y", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%m/%d/%y", "%m-%d-%y", "%d/%m/%y", "%d-%m-%y", "%d.%m.%y",
    "%b %d, %Y", "%b %d %Y", "%B %d, %Y", "%B %d %Y", "%b %d, %y", "%b %d %y", "%B %d, %y", "%B %d %y", "%d %b %Y", "%d %B %Y", "%d %b %y", "%d %B %y",
)
# Patterns.
AMOUNT = r"(?i)(?:rm|usd|eur|aed|\$)?\s*[-+]?(?:\d[\d., ]*\d|\d*[.,]\d{1,2})"
TIME = r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
DATE_LIKE = r"\d{1,4}[/-]\d{1,2}"
PHONE_LIKE = r"^\+?\d[\d\s().-]{6,}\d$"
LONG_NUMBER = r"(?<!\d)\d{7,}(?!\d)"
PLAIN_NUMBER = r"\d[\d.,]*"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# The order of features in a vector.
IMAGE_FEATURES = (
    "img_mean", "img_std", "img_median", "edge_mean", "edge_std", "noise_std", "noise_mean", "dynamic_range", "entropy", "block_var_std",
    "block_var_mean", "aspect_ratio", "total_pixels", "p5", "p95",
)
ELA_FEATURES = ("ela_mean", "ela_std", "ela_max", "ela_high_ratio", "ela_block_std")
TEXT_FEATURES = ("text_length", "line_count", "digit_ratio", "alpha_ratio", "special_ratio", "avg_line_length", "empty_line_ratio")
CONSISTENCY_FEATURES = ("amount_in_text", "amount_zscore", "amount_iqr_gap", "known_vendor_hit", "numeric_line_ratio", "amount_token_gap", "consistency_risk")
EXTRA_FEATURES = ("ocr_mean_confidence", "ocr_low_conf_ratio", "line_count", "word_count", "vendor_confidence", "date_confidence", "total_confidence", "field_presence")
LOCAL_FEATURES = (
    "field_ela_vendor", "field_ela_date", "field_ela_total", "field_conf_vendor", "field_conf_date", "field_conf_total",
    "field_present_vendor", "field_present_date", "field_present_total", "field_conflict_count",
)
PROMPT_FEATURES = (
    "ela_high_ratio", "ela_max", "ocr_low_conf_ratio", "ocr_mean_confidence", "field_conflict_count", "consistency_risk", "amount_zscore", "amount_iqr_gap",
    "field_ela_vendor", "field_conf_vendor", "field_ela_date", "field_conf_date", "field_ela_total", "field_conf_total",
    "field_present_vendor", "field_present_date", "field_present_total",
)
# Names of the synthetic vendors.
COMMON_VENDORS = (
    "7-Eleven", "McDonald's", "Walmart", "Starbucks", "CVS Pharmacy", "Target", "Subway", "Shell Gas", "BP Station", "Carrefour", "Lulu Hypermarket",
    "Al Meera", "KFC", "Pizza Hut", "Dominos", "Noon.com", "Talabat", "Nandos", "Costa Coffee", "Tim Hortons", "IKEA", "H&M", "Zara", "Noon Express", "Careem",
)
SUSPICIOUS_VENDORS = ("ACME Corp", "XYZ Store", "Generic Shop", "Unknown Vendor", "Test Store", "Temp Business", "Cash Only Store")
# Reasons, with the features and weights they stand for in operators/anomaly.py, and the sentences of a summary.
REASONS = (
    "Elevated ELA artifact ratio", "High residual noise", "Field consistency risk is high", "Large share of low-confidence OCR tokens",
    "Weak total extraction confidence", "Missing key fields",
)
MODEL_REASON = "Model-based anomaly estimate"
SUSPICIOUS_OPENERS = (
    "The document appears suspicious", "The receipt shows indicators of possible manipulation", "This document warrants concern for potential tampering",
)
GENUINE_OPENERS = (
    "The document appears genuine", "The receipt is broadly consistent with an untampered document", "No strong signs of forgery are apparent in this document",
)
LEADS = (
    "This assessment is based on several observable indicators:", "The conclusion is supported by the following findings:", "Key factors informing this assessment include:",
)
EVIDENCE = (
    "Signs of digital manipulation were detected in the image, with elevated high-ELA regions",
    "Text quality appears degraded, suggesting possible tampering or post-processing",
    "Key fields are missing (%s)",
    "The reported total does not align cleanly with other amount evidence on the document",
    "The total amount is unusually high or low compared with the learned document distribution",
    "Suspicious patterns were detected near the %s field",
)
NO_EVIDENCE_FORGED = "The current indicators are limited, but the combined anomaly score warrants manual review."
NO_EVIDENCE_GENUINE = "No material irregularities were identified in the extracted text, field structure, or image characteristics."
CLOSINGS = (
    "Targeted verification of the highlighted fields would be appropriate before accepting the document",
    "The missing field coverage reduces confidence in the document record and should be checked manually",
    "Taken together, these indicators support a cautious forensic interpretation",
    "Overall, the document structure remains largely coherent despite the noted weak signals",
)
