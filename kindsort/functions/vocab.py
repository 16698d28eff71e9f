"""Vocabularies and label sets.

Everything below the FIXED VALUES marker must stay equal to the behaviour being
reproduced: the keyword lists are matched as raw lower-case substrings, their
order is the priority order of the category rules, and duplicates are kept as
written (the compiler removes them while keeping the first position).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reproduced behaviour; do not edit or reorder)
# ---------------------------------------------------------------------------

CATEGORY_LABELS = [
    "Medical Equipment & Furniture",
    "Medical & Surgical Supplies",
    "PPE & Infection Control",
    "Cleaning & Facility Maintenance",
    "Diagnostics & Lab Use",
]

# keyword -> category, first match in this order wins
CATEGORY_RULES = [
    ("table", "Medical Equipment & Furniture"),
    ("chair", "Medical Equipment & Furniture"),
    ("bed", "Medical Equipment & Furniture"),
    ("cart", "Medical Equipment & Furniture"),
    ("light", "Medical Equipment & Furniture"),
    ("stool", "Medical Equipment & Furniture"),
    ("cabinet", "Medical Equipment & Furniture"),
    ("monitor", "Medical Equipment & Furniture"),
    ("scale", "Medical Equipment & Furniture"),
    ("syringe", "Medical & Surgical Supplies"),
    ("needle", "Medical & Surgical Supplies"),
    ("bandage", "Medical & Surgical Supplies"),
    ("gauze", "Medical & Surgical Supplies"),
    ("tape", "Medical & Surgical Supplies"),
    ("glove", "Medical & Surgical Supplies"),
    ("tubing", "Medical & Surgical Supplies"),
    ("catheter", "Medical & Surgical Supplies"),
    ("dressing", "Medical & Surgical Supplies"),
    ("suture", "Medical & Surgical Supplies"),
    ("scalpel", "Medical & Surgical Supplies"),
    ("blade", "Medical & Surgical Supplies"),
    ("mask", "PPE & Infection Control"),
    ("gown", "PPE & Infection Control"),
    ("shield", "PPE & Infection Control"),
    ("goggle", "PPE & Infection Control"),
    ("sanitizer", "PPE & Infection Control"),
    ("ppe", "PPE & Infection Control"),
    ("protection", "PPE & Infection Control"),
    ("face", "PPE & Infection Control"),
    ("disinfectant", "Cleaning & Facility Maintenance"),
    ("wipe", "Cleaning & Facility Maintenance"),
    ("cleaner", "Cleaning & Facility Maintenance"),
    ("detergent", "Cleaning & Facility Maintenance"),
    ("soap", "Cleaning & Facility Maintenance"),
    ("sanitizing", "Cleaning & Facility Maintenance"),
    ("bleach", "Cleaning & Facility Maintenance"),
    ("mop", "Cleaning & Facility Maintenance"),
    ("test", "Diagnostics & Lab Use"),
    ("lab", "Diagnostics & Lab Use"),
    ("specimen", "Diagnostics & Lab Use"),
    ("culture", "Diagnostics & Lab Use"),
    ("slide", "Diagnostics & Lab Use"),
    ("microscope", "Diagnostics & Lab Use"),
    ("analyzer", "Diagnostics & Lab Use"),
    ("reagent", "Diagnostics & Lab Use"),
    ("diagnostic", "Diagnostics & Lab Use"),
]

FACILITY_LABELS = [
    "Rural Clinics",
    "District Hospitals",
    "Both",
    "Needs Review",
]

RURAL_KEYWORDS = [
    "blood pressure monitor", "thermometer", "stethoscope", "weight scale",
    "glucometer", "hemoglobinometer", "nebulizer", "oxygen concentrator",
    "fetoscope", "delivery kit", "wound care", "dressing", "bandage",
    "sterilization", "autoclave", "pressure cooker", "rapid test",
    "hiv test", "malaria test", "pregnancy test", "urinalysis", "dipstick",
    "first aid", "oral medication", "injection", "immunization", "vaccine",
    "iv fluid", "cannula", "catheter", "splint", "crutch",
    "otoscope", "ophthalmoscope", "tongue depressor", "reflex hammer",
    "tape measure", "height measure", "scale", "pulse oximeter",
    "examination table", "examination lamp", "cold chain", "vaccine carrier",
    "sharps container", "waste bin", "biohazard", "glove", "mask", "cap",
    "apron", "forceps", "scissors", "needle", "syringe", "suture",
    "antiseptic", "disinfectant", "cotton", "gauze", "tape", "plaster",
    "thermometer", "measuring cup", "spoon", "dropper", "tablet", "capsule",
    "infant scale", "measuring tape", "fetal doppler", "birthing kit",
    "suction bulb", "umbilical cord", "delivery mat", "partograph",
    "disposable", "consumable", "basic", "manual", "hand-held", "portable",
]

DISTRICT_KEYWORDS = [
    "ventilator", "ecg", "electrocardiograph", "chemistry analyzer",
    "hematology analyzer", "operating table", "surgical", "anesthesia",
    "electrosurgical", "ceiling light", "operating light", "slit lamp",
    "ophthalmology", "x-ray", "radiography", "ultrasound", "imaging",
    "incubator", "blood bank", "refrigerator", "cpap", "icu", "intensive care",
    "cesarean", "theatre", "surgery", "fracture", "biopsy", "endoscopy",
    "laparoscopy", "microscope", "centrifuge", "culture", "microbiology",
    "monitor", "patient monitor", "fetal monitor", "cross matching", "transfusion",
    "defibrillator", "cardiac", "specialized", "advanced", "complex", "automated",
    "ekg", "ecg", "electrosurgical", "cautery", "diathermy", "coagulation",
    "blood gas", "dialysis", "hemodialysis", "peritoneal", "infusion pump",
    "syringe pump", "suction machine", "anesthesia machine", "ventilator",
    "resuscitator", "laryngoscope", "intubation", "orthopedic", "cast",
    "traction", "arthroscopy", "gastroscopy", "colposcopy", "colonoscopy",
    "bronchoscopy", "cystoscopy", "ent", "dermatology", "ophthalmology",
    "dental", "sterilization equipment", "autoclave", "ethylene oxide",
    "surgical instrument", "surgical light", "surgical table", "surgical drill",
    "surgical saw", "implant", "prosthetic", "theater", "theatre", "operating room",
]

REVIEW_KEYWORDS = [
    "expired", "damaged", "recalled", "obsolete", "discontinued",
    "complex", "specialized", "calibration required", "maintenance intensive",
    "proprietary", "requires training", "missing components", "advanced",
    "high power", "continuous electricity", "climate controlled", "mri", "ct scan",
    "radiation", "radioactive", "nuclear", "restricted", "controlled substance",
]

# Outcome labels of the classifiers
UNCATEGORIZED = "Uncategorized"
NEEDS_REVIEW = "Needs Review"
BOTH = "Both"
RURAL = "Rural Clinics"
DISTRICT = "District Hospitals"
YES = "Yes"
NO = "No"
NO_DESCRIPTION = "No description available"
DESCRIPTION_ERROR_PREFIX = "Error generating description: "

# Column names of the inventory layout, in file order
EXPECTED_COLUMNS = [
    "DIST_NO", "DC_NAME", "ITEM_NO", "VEND_CAT_NUM",
    "AVAILABILITY_QTY", "SELL_UOM", "ABC_CODE",
    "VENDOR_ABBR", "VENDOR_NAME", "DESCRIPTION",
    "COST", "EXT_COST", "GROSS_CUBIC", "CUBIC_FEET",
    "EXT_GROSS_CUBIC", "EST_PALLETS", "CATEGORY",
    "SUBCATEGORY", "DATING", "AGE_DESC",
    "REGULATION", "LEGEND_DESCRIPTION",
]
REQUIRED_COLUMNS = ["ITEM_NO", "DESCRIPTION", "VENDOR_NAME"]

# Output columns added by the stages
CATEGORY_COL = "Product Category"
FACILITY_COL = "Facility Suitability"
SIMPLE_DESC_COL = "SIMPLE_DESCRIPTION"

# Model-call parameters per stage: (max_tokens, temperature)
STAGE_PARAMS = {
    "category": (30, 0.0),
    "facility": (30, 0.1),
    "electricity": (10, 0.1),
    "description": (60, 0.3),
}
MAX_ATTEMPTS = 3
COST_PER_1K_TOKENS = 0.002
DEFAULT_BATCH_SIZE = 50
SAMPLE_SIZE = 10
PREVIEW_ROWS = 5

# Cell values a pandas CSV read turns into missing values (whole cell,
# case-sensitive); the empty string is among them.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Characters Python's str.strip() removes by default (str.isspace)
PY_WHITESPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
    (0x3000, 0x3000),
]

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------


def distinct_in_order(words):
    """Drop repeated words, keeping the first position of each."""
    seen = set()
    out = []
    for w in words:
        if w not in seen:
            seen.add(w)
            out.append(w)
    return out
