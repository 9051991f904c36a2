"""Fixed values of the text functions: dictionaries that results depend on."""

#: Legal forms that name tokens lose.
LEGAL_SUFFIXES = (
    "cie co company corp corporation et eurl fils gmbh inc incorporated limited llc llp lp ltd pc plc pllc private pvt sa sarl sas sasu sci scop snc"
).split()
#: Legal forms and stop words of core names.
CORE_LEGAL = (
    "cie co compagnie company corp corporation eurl gie gmbh inc incorporated limited llc llp lp ltd ltda pc plc pllc private pvt sa sarl sas sasu"
    " sca sci scop scs selarl snc"
).split()
CORE_STOP = "amp and bros brothers d de des du et fils freres frs l la le les of sons the".split()
#: Address abbreviations.
ADDRESS_WORDS = {
    "all": "allee", "apt": "apartment", "av": "avenue", "ave": "avenue", "bd": "boulevard", "bld": "boulevard", "bldg": "building",
    "blvd": "boulevard", "cir": "circle", "ct": "court", "dr": "drive", "e": "east", "fl": "floor", "hwy": "highway", "ln": "lane",
    "mkt": "market", "n": "north", "no": "number", "nr": "near", "opp": "opposite", "pkwy": "parkway", "pl": "place", "r": "rue",
    "rd": "road", "s": "south", "sq": "square", "st": "street", "ste": "suite", "str": "street", "ter": "terrace", "w": "west",
}
LANDMARKS = "adjacent behind beside near next nr opp opposite".split()
#: Name abbreviations of the French locale, and more of them for core names.
NAME_WORDS = {
    "compagnie": "cie", "etabl": "etablissements", "etablissement": "etablissements", "ets": "etablissements", "fr": "freres",
    "frs": "freres", "st": "saint", "ste": "sainte",
}
CORE_WORDS = NAME_WORDS | {"cie": "compagnie"}
FRENCH_STREETS = "all allee av avenue bd boulevard chemin cours impasse place quai r route rue".split()
#: US states and their codes.
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct",
    "delaware": "de", "district of columbia": "dc", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il",
    "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne",
    "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc",
    "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri",
    "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va",
    "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}
#: Indian state codes (the first two are aliases used in the data).
INDIAN_STATES = {
    "an": "andaman nicobar", "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh",
    "ch": "chandigarh", "ct": "chhattisgarh", "dl": "delhi", "ga": "goa", "gj": "gujarat", "hp": "himachal pradesh", "hr": "haryana",
    "jh": "jharkhand", "jk": "jammu kashmir", "ka": "karnataka", "kl": "kerala", "la": "ladakh", "mh": "maharashtra", "ml": "meghalaya",
    "mn": "manipur", "mp": "madhya pradesh", "mz": "mizoram", "nl": "nagaland", "od": "odisha", "or": "odisha", "pb": "punjab",
    "py": "puducherry", "rj": "rajasthan", "sk": "sikkim", "tg": "telangana", "tn": "tamil nadu", "tr": "tripura", "ts": "telangana",
    "uk": "uttarakhand", "up": "uttar pradesh", "ut": "uttarakhand", "wb": "west bengal",
}
#: Words that make an address part a street, and words that name no street.
STREET_WORDS = (
    "allee alley avenue boulevard chemin circle cours court drive esplanade highway impasse lane lieu loop parkway passage path pike place plaza"
    " quai road route row rue sentier square street terrace trail walk way"
).split()
STREET_FILL = (
    "apartment au aux bis d de des du east en et floor l la le les n no north number nº of saint sainte south st ste suite sur ter the unit west"
).split()
#: Sounds of Indic letters by the last part of their Unicode names.
VOWELS = {
    "A": "a", "AA": "aa", "AI": "ai", "AU": "au", "AW": "au", "CANDRA A": "a", "CANDRA E": "e", "CANDRA O": "o", "E": "e", "EE": "e",
    "I": "i", "II": "i", "O": "o", "OO": "o", "SHORT A": "a", "SHORT E": "e", "SHORT O": "o", "U": "u", "UU": "u", "VOCALIC L": "li",
    "VOCALIC LL": "li", "VOCALIC R": "ri", "VOCALIC RR": "ri",
}
CONSONANTS = {
    "BA": "b", "BHA": "bh", "CA": "ch", "CHA": "chh", "DA": "d", "DDA": "d", "DDDHA": "r", "DDHA": "dh", "DHA": "dh", "FA": "f",
    "GA": "g", "GHA": "gh", "GHHA": "g", "HA": "h", "JA": "j", "JHA": "jh", "JJA": "j", "JNYA": "gn", "K": "k", "KA": "k", "KHA": "kh",
    "KHHA": "kh", "KSHA": "ksh", "KSSA": "ksh", "LA": "l", "LLA": "l", "LLLA": "l", "MA": "m", "NA": "n", "NGA": "n", "NNA": "n",
    "NNNA": "n", "NYA": "n", "PA": "p", "PHA": "ph", "QA": "k", "RA": "r", "RHA": "r", "RRA": "r", "SA": "s", "SHA": "sh", "SSA": "sh",
    "TA": "t", "THA": "th", "TTA": "t", "TTHA": "th", "TTTA": "t", "VA": "v", "WA": "v", "YA": "y", "YYA": "y", "ZA": "z", "ZHA": "l",
}
SIGNS = {"ANUSVARA": "n", "ANUSVARA ABOVE": "n", "CANDRABINDU": "n", "VISARGA": "h"}
DIGITS = {name: str(i) for i, name in enumerate("ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE".split())}
#: Scripts whose words lose a final a, and spellings that sound alike, in the order they are replaced.
FINAL_A_SCRIPTS = ("BENGALI", "DEVANAGARI", "GUJARATI", "GURMUKHI", "ORIYA")
SOUNDS = (
    ("ph", "f"), ("sh", "s"), ("chh", "c"), ("ch", "c"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("jh", "j"),
    ("ck", "k"), ("q", "k"), ("x", "ks"), ("w", "v"), ("z", "j"), ("y", "i"), ("c", "k"),
)
#: Skeletons of legal forms, as names in Latin and Indic scripts give them.
LEGAL_SKELETONS = "ers in ink inkrprtd inks kmpn kmpni ko kri lk llk llp lmtd ltd pk prvt pvt sas sasu sk srl".split()
#: Patterns of dotted initials (closed up in this order), of trading names and of domain names.
DOTTED = (r"\b([a-z])\.(?=[a-z]\.)", r"\b([a-z])\.([a-z])\.?\b")
TRADE_NAME = r"\b(dba|trading as|t/a|aka)\b"
DOMAIN_NAME = r"\.(com|fr|net|org|in|co)\b"
