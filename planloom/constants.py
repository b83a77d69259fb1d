"""Fixed values the results depend on (thresholds, code ranges, word lists).

Everything here is data, stated plainly; operators take most of these as
keyword defaults so that a caller can override them.
"""

# fixed values: axis names (v = left/right, h = top/bottom)
AXES = ("v", "h", "both")

# fixed values: reading passes, in order, with their claimed angle
PASS_ANGLES = ((0, 0.0), (1, 90.0), (2, -90.0))

# fixed values: the five cardinal reading angles, in comparison order
CARDINALS = (-180.0, -90.0, 0.0, 90.0, 180.0)

# fixed values: detection and merge thresholds
LOW_CONFIDENCE = 0.85
MERGE_IOU = 0.3
MERGE_CONTAINMENT = 0.6
REPLACE_MARGIN = 0.05
FRAGMENT_CONTAINMENT = 0.9
MATCH_MIN_IOU = 0.15
PLAUSIBLE_ASPECT = 1.15
MIN_ASPECT_FOR_QUAD_ANGLE = 1.5
ALWAYS_SNAP_DEG = 3.0
UNAMBIGUOUS_TILT_DEG = 20.0
TILT_TOLERANCE_DEG = 1.0
MISSED_TEXT_MIN_LEN = 3
MISSED_TEXT_COVER = 0.5
REREAD_OVERLAP = 0.8
SHORT_UNKNOWN_LEN = 2

# fixed values: sheet resolution decision (pixels of median cap height)
CAP_SHARE = 0.72
REFUSE_CAP_PX = 8.0
UPSCALE_CAP_PX = 14.0

# fixed values: size clustering and fitting
SIZE_GAP = 0.12
SIZE_MAX_OVERSHOOT = 1.20
TRACKING_RANGE = (-0.08, 0.15)
SCALE_RANGE = (0.96, 1.25)
CONDENSED_OVERFLOW = 1.04

# fixed values: dimension range in millimetres, inclusive
DIM_MIN_MM = 200
DIM_MAX_MM = 20000
MIN_FUZZY_HEAD_LEN = 3

# Own calibration: 100 * (1 - levenshtein / longer length) on folded text.
FUZZY_MIN_SCORE = 70.0

# fixed values: gate bands, pads (pixels) and clearance moves (pixels)
HEIGHT_BAND = (0.85, 1.15)
FOOTPRINT_PAD_PX = 12
ERASED_PAD_PX = 7
INK_PAD_PX = 2
CLEARANCE_STEPS_PX = (4, 8, 14, 22)
MOSTLY_HIDDEN = 0.5
OVERFLOW_LIMIT = 1.15
GATE_PASSES = 3
UNRESOLVED_CODES = ("low-confidence", "implausible", "annotation-confusable")
ACCEPTABLE_CODES = ("low-confidence", "annotation-confusable")

# fixed values: pixel comparison
DIFF_THRESHOLD = 60
TEXT_EXCLUSION_PAD_PX = 20
DARK_LUMA = 128
RING_PX = 6
BUCKET_LEVELS = 8
PATTERN_STD = 18.0
LINE_MIN_RUN = 40
SOLID_ALPHA = 0.999
INK_CHANNEL_LIMIT = 245
LUMA_BGR = (0.114, 0.587, 0.299)

# fixed values: vector text
TRANSFORM_TOLERANCE_PT = 0.75
MATRIX_TOLERANCE = 1e-6
SNAP_TOLERANCE_PT = 4.0
PICTURE_LABEL_CONF = 0.9
PICTURE_LABEL_ANGLES = (0.0, 90.0, -90.0)
OCR_DPI = 300

# fixed values: input routing by suffix and by leading bytes
VECTOR_SUFFIXES = ("pdf",)
PDF_MARK_HEX = "255044462D"  # %PDF-, anywhere in the first 1024 bytes
RASTER_SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")
MAGIC_HEX = (
    ("89504E47", "png"),
    ("FFD8", "jpeg"),
    ("49492A00", "tiff"),
    ("4D4D002A", "tiff"),
    ("424D", "bmp"),
)

# fixed values: code point ranges a Latin-script plan never uses
NON_LATIN_RANGES = (
    (0x0400, 0x04FF),
    (0x0590, 0x08FF),
    (0x2E80, 0x9FFF),
    (0x3040, 0x30FF),
    (0xAC00, 0xD7A3),
)

# fixed values: closed vocabulary, in priority order
ROOMS = (
    "Stue", "Opholdsrum", "Køkken", "Køkken/alrum", "Alrum", "Spisestue",
    "Værelse", "Vær.", "Soveværelse", "Kammer", "Bad", "Badeværelse",
    "Toilet", "WC", "Bad/WC", "Entré", "Entre", "Gang", "Repos", "Trappe",
    "Bryggers", "Vaskerum", "Depot", "Pulterrum", "Skab", "Garderobe",
    "Walk-in", "Teknik", "Teknikrum", "Fordeler", "Loft", "Kælder",
    "Kælderrum", "Altan", "Terrasse", "Have", "Karnap", "Kontor", "Hall",
    "Vindfang", "Elevator", "Skunk", "Emhætte", "Køl/frys", "Ovn", "Opvask",
)
ABBREVIATIONS = (
    ("Vær", "Vær."),
    ("Vaer", "Vær."),
    ("Vr.", "Vær."),
    ("Kok", "Køkken"),
    ("Bad/Toilet", "Bad/WC"),
)
ANNOTATIONS = ("H*", "HS", "EL", "VVB", "GA", "ST", "T")
CONFUSABLES = (("1", "T"),)

# fixed values: base-14 font aliases as (regular, italic, bold, bold italic)
FONT_ALIASES = {
    "sans": ("helv", "heit", "hebo", "hebi"),
    "serif": ("tiro", "tiit", "tibo", "tibi"),
    "mono": ("cour", "coit", "cobo", "cobi"),
}
