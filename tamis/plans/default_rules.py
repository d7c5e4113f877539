"""The rules that come with the package: 36 detectors by pattern, one by word lists, ten profiles, two label markers."""

from __future__ import annotations

from .rules import Detector, Dictionary, Marker, Node, Profile, RuleSet

# Small word lists of our own: common names, and words that begin sentences or headings and so are no evidence of a name.
# Larger ones are read from files (`Dictionary` in rules given as JSON names their paths).
GIVEN_NAMES = """
    james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara
    susan jessica sarah karen jane maria anna laura emma olivia sophia lucas daniel peter paul mark george kevin brian
    edward steven anthony nancy lisa betty sandra ashley emily donna carol will may april
""".split()
SURNAMES = """
    smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson
    thomas taylor moore jackson martin lee perez thompson white harris sanchez clark ramirez lewis robinson walker young
    allen king wright scott torres nguyen hill flores green adams nelson baker hall campbell mitchell showers
""".split()
COMMON_WORDS = """
    i you he she it we they me him her us them this that these those who whom whose which what
    a an the some any each every both either neither few many much several all none
    am is are was were be been being do does did have has had can could shall should will would may might must ought
    in into on onto at by for from of off over under above below between among through during before after since until with
    without within against towards near beside
    and or but nor so yet if unless because although while whereas when where why how than as
    not never always often sometimes again then there here now soon already still also too only even
    white black green brown grey red blue young old king queen hill wood lake field stone summer winter spring autumn
""".split()
TITLES = "mr mrs ms miss dr prof sir madam".split()


def _all(*of: Node) -> Node:
    return Node("and", of=of)


def _any(*of: Node | str, least: int = 1) -> Node:
    return Node("or", least=least, of=tuple(_det(n) if isinstance(n, str) else n for n in of))


def _det(name: str, validated: int = 0) -> Node:
    return Node("detector", name, min_validated=validated)


DETECTORS = (
    Detector(
        "credit_card",
        60,
        (
            r"\b(?:4[0-9]{3}|5[1-5][0-9]{2}|2[2-7][0-9]{2}|6(?:011|5[0-9]{2}))(?:[ -]?[0-9]{4}){3}\b|\b3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}\b",
        ),
        validators=("luhn_check",),
        keywords=("card", "visa", "mastercard", "amex", "payment", "credit", "debit",),
        group="A",
        needs_digit=True,
    ),
    Detector(
        "iban",
        60,
        (
            r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
        ),
        validators=("iban_mod97",),
        keywords=("iban", "bank", "account", "wire",),
        group="A",
        needs_digit=True,
    ),
    Detector(
        "aba_routing",
        45,
        (
            r"\b[0-9]{9}\b",
        ),
        validators=("aba_checksum",),
        keywords=("routing", "aba", "rtn",),
        group="A",
        best_effort=True,
        needs_digit=True,
    ),
    Detector(
        "swift_bic",
        50,
        (
            r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b",
        ),
        keywords=("swift", "bic",),
        group="A",
        best_effort=True,
    ),
    Detector(
        "bank_account",
        45,
        (
            r"\b[0-9]{8,17}\b",
        ),
        keywords=("account number", "account no", "acct",),
        group="A",
        best_effort=True,
        needs_digit=True,
    ),
    Detector(
        "email",
        80,
        (
            r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
        ),
        keywords=("email", "e-mail", "contact",),
        group="B",
        literals=("@",),
    ),
    Detector(
        "ip_address",
        60,
        (
            r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b",
            r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b",
            r"\b(?:[0-9A-Fa-f]{1,4}:){1,6}:[0-9A-Fa-f]{1,4}\b",
        ),
        keywords=("ip address",),
        group="B",
        needs_digit=True,
        digit_or=("::", *(":" + c for c in "abcdefABCDEF")),
    ),
    Detector(
        "phone",
        55,
        (
            r"\(?\b[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}\b",
            r"\+[0-9]{1,3}[ .-]?(?:\(?[0-9]{1,4}\)?[ .-]?){2,4}[0-9]{2,4}\b",
        ),
        keywords=("phone", "tel", "call", "mobile", "fax",),
        group="B",
        needs_digit=True,
    ),
    Detector(
        "date_of_birth",
        50,
        (
            r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)[0-9]{2}\b",
            r"\b(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\b",
            r"\b(?:0?[1-9]|[12][0-9]|3[01]) (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* (?:19|20)[0-9]{2}\b",
        ),
        keywords=("dob", "date of birth", "born", "birth",),
        group="B",
        best_effort=True,
        needs_digit=True,
    ),
    Detector(
        "postal_address",
        50,
        (
            r"\b[0-9]{1,5} [A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)? (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)\b",
        ),
        keywords=("address", "street", "zip", "postcode",),
        group="B",
        best_effort=True,
        needs_digit=True,
    ),
    Detector(
        "url",
        50,
        (
            r"\bhttps?://[A-Za-z0-9.-]+(?:/[A-Za-z0-9._~/?#@!&*+,;=%-]*)?",
        ),
        group="B",
        literals=("http",),
    ),
    Detector(
        "vin",
        50,
        (
            r"\b[A-HJ-NPR-Z0-9]{17}\b",
        ),
        validators=("vin_check",),
        keywords=("vin", "vehicle",),
        group="B",
        needs_digit=True,
    ),
    Detector(
        "us_ssn",
        50,
        (
            r"\b[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}\b",
        ),
        validators=("ssn_check",),
        keywords=("ssn", "social security",),
        group="C",
        needs_digit=True,
    ),
    Detector(
        "us_ein",
        45,
        (
            r"\b[0-9]{2}-[0-9]{7}\b",
        ),
        validators=("ein_prefix",),
        keywords=("ein", "employer identification",),
        group="C",
        best_effort=True,
        needs_digit=True,
    ),
    Detector(
        "us_passport",
        50,
        (
            r"\b[0-9]{9}\b",
            r"\b[A-Z][0-9]{8}\b",
        ),
        keywords=("passport",),
        group="C",
        best_effort=True,
        needs_digit=True,
    ),
    Detector(
        "uk_nino",
        60,
        (
            r"\b[A-CEGHJ-PR-TW-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]\b",
        ),
        keywords=("nino", "national insurance",),
        group="C",
        needs_digit=True,
    ),
    Detector(
        "uk_passport",
        50,
        (
            r"\b[0-9]{9}\b",
        ),
        keywords=("passport",),
        group="C",
        best_effort=True,
        needs_digit=True,
    ),
    Detector(
        "uk_utr",
        50,
        (
            r"\b[0-9]{5} ?[0-9]{5}\b",
        ),
        keywords=("utr", "taxpayer reference",),
        group="C",
        best_effort=True,
        needs_digit=True,
    ),
    Detector(
        "mrn",
        50,
        (
            r"\b(?:MRN|mrn)[ :#-]*[0-9]{6,10}\b",
            r"\b[0-9]{6,10}\b",
        ),
        keywords=("mrn", "medical record",),
        group="D",
        best_effort=True,
        needs_digit=True,
    ),
    Detector(
        "us_npi",
        50,
        (
            r"\b[12][0-9]{9}\b",
        ),
        validators=("npi_check",),
        keywords=("npi", "provider",),
        group="D",
        needs_digit=True,
    ),
    Detector(
        "us_dea",
        50,
        (
            r"\b[A-Z][A-Z9][0-9]{7}\b",
        ),
        validators=("dea_check",),
        keywords=("dea",),
        group="D",
        needs_digit=True,
    ),
    Detector(
        "icd10",
        50,
        (
            r"\b[A-TV-Z][0-9]{2}(?:\.[0-9]{1,4})?\b",
        ),
        keywords=("diagnosis", "icd", "dx",),
        group="D",
        best_effort=True,
        needs_digit=True,
    ),
    Detector(
        "health_insurance",
        50,
        (
            r"\b[A-Z]{2,4}[0-9]{6,12}\b",
        ),
        keywords=("health insurance", "member id", "policy number", "insurance id",),
        group="D",
        best_effort=True,
        needs_digit=True,
    ),
    Detector(
        "api_key",
        70,
        (
            r"\bAKIA[0-9A-Z]{16}\b",
            r"\bghp_[0-9A-Za-z]{36}\b",
            r"\bAIza[0-9A-Za-z_-]{35}\b",
            r"\bxox[abprs]-[0-9A-Za-z-]{10,48}\b",
            r'\btoken = "[0-9a-f]{40}"',
        ),
        keywords=("key", "token", "secret",),
        group="E",
        literals=("AKIA", "ghp_", "AIza", "xox", 'token = "',),
    ),
    Detector(
        "private_key",
        80,
        (
            r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
        ),
        group="E",
        literals=("-----BEGIN",),
    ),
    Detector(
        "jwt",
        80,
        (
            r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
        ),
        keywords=("token", "bearer",),
        group="E",
        literals=("eyJ",),
    ),
    Detector(
        "us_itin",
        50,
        (
            r"\b9[0-9]{2}[- ]?[0-9]{2}[- ]?[0-9]{4}\b",
        ),
        validators=("itin_check",),
        keywords=("itin", "taxpayer",),
        group="C",
        needs_digit=True,
    ),
    Detector(
        "us_drivers_license",
        45,
        (
            r"\b[A-Z][0-9]{7,12}\b",
        ),
        keywords=("driver license", "drivers license", "driver's license", "dl number",),
        group="C",
        best_effort=True,
        needs_digit=True,
    ),
    Detector(
        "us_medicare_mbi",
        55,
        (
            r"\b[1-9][AC-HJKMNP-RT-Y][AC-HJKMNP-RT-Y0-9][0-9]-?[AC-HJKMNP-RT-Y][AC-HJKMNP-RT-Y0-9][0-9]-?[AC-HJKMNP-RT-Y]{2}[0-9]{2}\b",
        ),
        keywords=("medicare", "mbi",),
        group="D",
        needs_digit=True,
    ),
    Detector(
        "uk_drivers_license",
        55,
        (
            r"\b[A-Z9]{5}[0-9]{6}[A-Z9]{2}[A-Z0-9]{3}\b",
        ),
        keywords=("driving licence", "driver licence", "dvla",),
        group="C",
        needs_digit=True,
    ),
    Detector(
        "canada_sin",
        50,
        (
            r"\b[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{3}\b",
        ),
        validators=("sin_check",),
        keywords=("sin", "social insurance",),
        group="C",
        needs_digit=True,
    ),
    Detector(
        "fr_nir",
        50,
        (
            r"\b[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}\b",
        ),
        validators=("nir_check",),
        keywords=("nir", "insee", "sécurité sociale",),
        group="C",
        needs_digit=True,
    ),
    Detector(
        "de_tax_id",
        50,
        (
            r"\b[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b",
        ),
        validators=("de_tax_check",),
        keywords=("steuer", "idnr", "tax id",),
        group="C",
        needs_digit=True,
    ),
    Detector(
        "italy_codice_fiscale",
        60,
        (
            r"\b[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]\b",
        ),
        keywords=("codice fiscale",),
        group="C",
        needs_digit=True,
    ),
    Detector(
        "es_dni",
        50,
        (
            r"\b[0-9]{8}-?[A-Z]\b",
        ),
        validators=("es_dni_check",),
        keywords=("dni", "nif",),
        group="C",
        needs_digit=True,
    ),
    Detector(
        "nl_bsn",
        45,
        (
            r"\b[0-9]{9}\b",
        ),
        validators=("bsn_check",),
        keywords=("bsn", "burgerservicenummer",),
        group="C",
        best_effort=True,
        needs_digit=True,
    ),
    Detector(
        "person_name",
        0,
        keywords=("name", "patient", "customer", "employee"),
        group="B",
        kind="dictionary",
        dictionary=Dictionary(frozenset(GIVEN_NAMES), frozenset(SURNAMES), frozenset(COMMON_WORDS), frozenset(TITLES)),
    ),
)

_SOFT = ("email", "phone", "person_name", "date_of_birth", "postal_address")

PROFILES = (
    Profile("PCI", _det("credit_card", 1)),
    Profile("FINANCIAL", _any(_det("credit_card", 1), _det("iban", 1), _det("aba_routing", 1), "swift_bic", "bank_account")),
    Profile(
        "US_PII",
        _any(_det("us_ssn", 1), _det("us_itin", 1), _det("credit_card", 1), "us_passport", "us_drivers_license", _any(*_SOFT, least=2)),
    ),
    Profile("UK_PII", _any("uk_nino", "uk_passport", "uk_utr", "uk_drivers_license")),
    Profile("CA_PII", _det("canada_sin", 1)),
    Profile("EU_PII", _any(_det("fr_nir", 1), _det("de_tax_id", 1), "italy_codice_fiscale", _det("es_dni", 1), _det("nl_bsn", 1))),
    Profile(
        "PHI_HIPAA",
        _all(
            _any("mrn", _det("us_npi", 1), _det("us_dea", 1), "icd10", "health_insurance", "us_medicare_mbi"),
            _any(*_SOFT, _det("us_ssn", 1), least=2),
        ),
    ),
    Profile("SECRETS", _any("api_key", "private_key", "jwt")),
    Profile("EMAIL", _det("email"), "ESCALATE"),
    Profile("IP_ADDRESS", _det("ip_address")),
)

MARKERS = (
    Marker("sensitivity", "Sensitivity labels", ("Highly Confidential", "Confidential", "MSIP_Label"), ("MSIP_Label", "Sensitivity", "Classification")),
    Marker("classification", "Classification markings", ("INTERNAL USE ONLY", "PROPRIETARY", "TOP SECRET", "RESTRICTED"), ("DataClass", "DocSensitivity")),
)

DEFAULT_RULES = RuleSet(DETECTORS, PROFILES, MARKERS)
