"""Fixed values the reports are defined over."""

# The 25 provinces in official order (codes 1 to 25).
PROVINCES = (
    "បន្ទាយមានជ័យ", "បាត់ដំបង", "កំពង់ចាម", "កំពង់ឆ្នាំង", "កំពង់ស្ពឺ",
    "កំពង់ធំ", "កំពត", "កណ្ដាល", "កោះកុង", "ក្រចេះ",
    "មណ្ឌលគិរី", "ភ្នំពេញ", "ព្រះវិហារ", "ព្រៃវែង", "ពោធិ៍សាត់",
    "រតនគិរី", "សៀមរាប", "ព្រះសីហនុ", "ស្ទឹងត្រែង", "ស្វាយរៀង",
    "តាកែវ", "ឧត្ដរមានជ័យ", "កែប", "ប៉ៃលិន", "ត្បូងឃ្មុំ",
)

# The provinces with dai fishing, and the one left out of the marine reports.
DAI_PROVINCES = ("កណ្ដាល", "ភ្នំពេញ", "ព្រៃវែង")
EXCLUDED_FROM_MARINE = "កំពង់ធំ"

# Province codes on the coast; every other code is inland.
MARINE_CODES = ("7", "9", "18", "23")
MARINE, INLAND = "Marine", "Inland"
GROUPS = (MARINE, INLAND)

# Form codes.
AREA_FRESH, AREA_MARINE = "1", "2"
AREA_FRESH_CODES = ("1", "01")
TYPE_DAI, TYPE_DOMAIN, TYPE_RICE_FIELD = "1", "2", "3"

# Aquaculture species, form code to label.
SPECIES = {
    "78": "អន្ទង់",
    "77": "កង្កែប",
    "86": "កន្ធាយ",
    "84": "បង្កង់",
    "FM046": "បង្គា",
    "FM023": "ក្តាមថ្ម",
    "FM027": "គ្រែងឈាម",
    "22": "គ្រុំចំពុះទាក្រៀម",
    "85": "ក្រពើ",
}
FRESH_FISH, SEA_FISH = "ត្រីទឹកសាប", "ត្រីសមុទ្រ"

# Enforcement outcomes, form code to label.
OUTCOMES = {
    "2": "បំផ្លាញចោល (ករណី)",
    "3": "បញ្ជូនសំណុំរឿងទៅតុលាការ (ករណី)",
    "6": "ពិន័យអន្តរការណ៍ (ករណី)",
}

# Facility types and the words that stand for them in free text.
FACILITIES = {
    "ponds": ("pond", "ponds"),
    "batches": ("batch", "batches"),
    "plastic soung": ("plastic", "soung"),
}

# Column headings of the reports.
TOTAL, PROVINCE_HEADING, ROW_NUMBER_HEADING = "សរុប", "ខេត្ត", "ល.រ"
PROVINCE_OR_CAPITAL = "ខេត្ត/រាជធានី"

# Number of species on the marine sheet, weeks of a month, missing-value tokens.
TOP_SPECIES = 51
WEEKS = ("Week1", "Week2", "Week3", "Week4", "Week5")
QUARTERS = ("Q1", "Q2", "Q3", "Q4")
NULL_TOKEN, UNSPECIFIED = "null", "unspecified"

# Where each result goes in the report workbook.
SHEETS = {
    "t06_species_detail": "T06Deail_ប្រភេទត្រីសមុទ្រ",
    "t06_marine_species": "T06_ប្រភេទត្រីសមុទ្រ",
    "t07_aquaculture": "T07_ផលវារីវប្បកម្ម",
    "t05_marine_province": "T05_ផលនេសាទសមុទ្រ",
    "t04_rice_field": "T04_ផលក្នុងវាលស្រែ",
    "t03_fishery_domain": "T03_ផលក្នុងដែននេសាទ",
    "t02_dai": "T02_ផលឧបករណ៍ដាយ",
    "t08_enforcement": "T08_បទល្មើស",
    "t10_facilities": "T10_ស្រះ បែ ស៊ង",
}

# Columns dropped from each cleaned table where present.
DROP_SUBMISSION = (
    "formhub_uuid", "begin_group_v0pfmszve_nat_sum", "begin_group_v0pfmszve_aqu_sum",
    "begin_group_v0pfmszve_total_sum", "validation_status_color", "law_other_enforce",
    "validation_status_timestamp", "validation_status_uid", "validation_status_by_whom",
    "validation_status_label", "law_remarklaw", "notes", "meta_root_uuid",
    "meta_deprecatedid", "attachments", "submissiontime", "submittedby", "version",
    "meta_instanceid", "meta_rootuuid", "tags", "xform_id_string", "status",
)
DROP_CAPTURE = (
    "natfishcatch_commentnat", "natfishcatch_natother",
    "natfishcatch_integeroak3bkt86", "natfishcatch_integermle6vfl0n",
)
DROP_AQUACULTURE = ("aqufishcatch_aquother", "aqufishcatch_comment")
DROP_PROCESSING = ("processing_otherprocessing", "processing_remark")
DROP_PATROL = ("patrol_remark_crime", "patrol_other_crime", "patrol_other_enforce")

# The repeat groups of a submission.
REPEATS = ("nat_fishcatch", "aqu_fishcatch", "processing", "patrol")
