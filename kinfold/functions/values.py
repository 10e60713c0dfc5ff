"""Fixed values that results depend on."""

# Digits of nine scripts, each from zero to nine.
INDIC_ZEROS = (0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66)

# Words of legal forms and what stands for them, in the order in which they are applied.
LEGAL_FORMS = (
    (r"pvt\s*ltd", "private limited"), (r"co\s*ltd", "company limited"), ("pvt", "private"), ("ltd", "limited"), ("corp", "corporation"),
    ("inc", "incorporated"), ("co", "company"), ("llc", "llc"), ("sarl", "sarl"), ("sas", "sas"), ("gmbh", "gmbh"),
)

# Address abbreviations.
ADDRESS_FORMS = (
    ("rd", "road"), ("st", "street"), ("ave", "avenue"), ("blvd", "boulevard"), ("dr", "drive"), ("hwy", "highway"), ("ste", "suite"),
    ("apt", "apartment"), ("fl", "floor"), ("bldg", "building"),
)

# Words that carry no weight in names.
STOP_WORDS = (
    "and the of in at on for with to a an private limited corporation incorporated company llc sarl sas gmbh pvt ltd corp inc co services enterprises"
    " trading solutions associates"
).split()

# Further words that carry no weight in addresses.
ADDRESS_STOP_WORDS = STOP_WORDS + (
    "street road avenue boulevard drive court lane place circle way trail parkway highway suite floor apartment building room number near opposite behind"
    " beside block sector phase plot flat door unit north south east west state district city country india usa us null rd st ave blvd dr ct ln hwy apt"
    " ste fl nagar colony bazaar market marg gali ward village gram tehsil taluk rue route chemin impasse allee square voie passage cours quai cedex"
    " france batiment residence industrielle saint sainte de des du la le les l d au aux en sur sous"
).split()

# Words that announce a landmark.
LANDMARK_WORDS = "near opp opposite behind beside adj adjacent".split()

# Blocks of seven parallel scripts, and Latin sounds by offset within a block.
SCRIPT_BLOCKS = {"devanagari": 0x0900, "bengali": 0x0980, "gujarati": 0x0A80, "tamil": 0x0B80, "telugu": 0x0C00, "kannada": 0x0C80, "malayalam": 0x0D00}
SOUNDS = {
    0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ee", 0x09: "u", 0x0A: "oo", 0x0F: "e", 0x10: "ai", 0x13: "o", 0x14: "au",
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "ny",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x32: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h",
    0x3E: "a", 0x3F: "i", 0x40: "ee", 0x41: "u", 0x42: "oo", 0x47: "e", 0x48: "ai", 0x4B: "o", 0x4C: "au", 0x4D: "",
}
# Signs that most scripts have, short vowels that some have, and what each script adds to the sounds, or lacks.
MARKS = {0x01: "n", 0x02: "n", 0x03: "h"}
SHORT_VOWELS = {0x0E: "e", 0x12: "o", 0x46: "e", 0x4A: "o"}
SCRIPT_EXTRAS = {
    "devanagari": MARKS | {0x0B: "ri", 0x3C: ""}, "bengali": MARKS, "gujarati": MARKS | {0x33: "l"}, "telugu": {0x02: "n", 0x03: "h", 0x33: "l"} | SHORT_VOWELS,
    "kannada": {0x02: "n", 0x03: "h", 0x33: "l"} | SHORT_VOWELS, "malayalam": {0x02: "n", 0x03: "h", 0x33: "l", 0x34: "zh"} | SHORT_VOWELS,
    "tamil": {0x03: "k", 0x1A: "ch", 0x24: "th", 0x29: "n", 0x31: "r", 0x33: "l", 0x34: "zh"} | SHORT_VOWELS,
}
SCRIPT_GAPS = {
    "bengali": (0x35,), "tamil": (0x16, 0x17, 0x18, 0x1B, 0x1D, 0x20, 0x21, 0x22, 0x25, 0x26, 0x27, 0x2B, 0x2C, 0x2D, 0x36),
}


def sounds() -> dict[str, str]:
    """Latin sounds of the letters and signs of the seven scripts."""
    table: dict[str, str] = {}
    for script, block in SCRIPT_BLOCKS.items():
        own = {k: v for k, v in SOUNDS.items() if k not in SCRIPT_GAPS.get(script, ())} | SCRIPT_EXTRAS[script]
        table |= {chr(block + offset): sound for offset, sound in own.items()}
    return table
