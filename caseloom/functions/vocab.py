"""Vocabularies of the term normaliser. Results depend on each entry and on their order."""

from __future__ import annotations

#: Trade name or variant -> ingredient.
BRANDS = {
    "lipitor": "atorvastatin", "glucophage": "metformin", "zestril": "lisinopril", "prinivil": "lisinopril", "norvasc": "amlodipine",
    "prilosec": "omeprazole", "synthroid": "levothyroxine", "levoxyl": "levothyroxine", "cozaar": "losartan", "neurontin": "gabapentin",
    "microzide": "hydrochlorothiazide", "hctz": "hydrochlorothiazide", "zoloft": "sertraline", "zocor": "simvastatin", "singulair": "montelukast",
    "plavix": "clopidogrel", "crestor": "rosuvastatin", "lasix": "furosemide", "tylenol": "acetaminophen", "paracetamol": "acetaminophen",
    "advil": "ibuprofen", "motrin": "ibuprofen", "diovan": "valsartan",
}

#: Wording -> preferred event term; earlier entries win in the phrase search.
SYNONYMS = {
    "throwing up": "nausea", "emesis": "nausea", "vomiting": "nausea", "nauseous": "nausea", "feeling sick": "nausea", "upset stomach": "nausea",
    "loose stools": "diarrhea", "diarrhoea": "diarrhea", "watery stool": "diarrhea",
    "head ache": "headache", "cephalalgia": "headache", "migraine": "headache",
    "lightheaded": "dizziness", "lightheadedness": "dizziness", "vertigo": "dizziness", "dizzy": "dizziness",
    "tiredness": "fatigue", "exhaustion": "fatigue", "lethargy": "fatigue", "malaise": "fatigue",
    "can't sleep": "insomnia", "sleeplessness": "insomnia", "sleep disorder": "insomnia",
    "skin rash": "rash", "hives": "rash", "urticaria": "rash", "skin eruption": "rash",
    "itching": "pruritus", "itchy skin": "pruritus", "itchiness": "pruritus",
    "shortness of breath": "dyspnea", "breathlessness": "dyspnea", "sob": "dyspnea", "dyspnoea": "dyspnea",
    "joint pain": "arthralgia", "pain in joints": "arthralgia", "muscle pain": "myalgia", "muscle ache": "myalgia", "muscle aches": "myalgia",
    "acute kidney failure": "acute kidney injury", "renal failure": "acute kidney injury", "kidney damage": "acute kidney injury",
    "renal impairment": "acute kidney injury", "aki": "acute kidney injury",
    "liver failure": "hepatotoxicity", "liver damage": "hepatotoxicity", "hepatic injury": "hepatotoxicity", "elevated lfts": "hepatotoxicity",
    "elevated lft": "hepatotoxicity", "jaundice": "hepatotoxicity",
}

DRUGS = sorted(set(BRANDS.values()))
EVENTS = sorted(set(SYNONYMS.values()))

#: Words for forms, routes and hydrates, which name no ingredient.
FORMS = (
    "tablets tablet tabs tab capsules capsule caps cap patch xr er sr dr cr ir otc oral iv im sc subcutaneous sublingual topical transdermal "
    "inhalation inhaled nasal intranasal intravenous intramuscular rectal ophthalmic otic gel cream ointment lotion solution soln suspension susp "
    "syrup elixir injection inj spray drops film coated extended release delayed hfa trihydrate dihydrate monohydrate hemihydrate anhydrous micronized"
).split()
#: Ions, which name no ingredient after another word.
CATIONS = "calcium potassium sodium magnesium".split()
ANIONS = "hcl hydrochloride dihydrochloride besylate mesylate fumarate maleate succinate tartrate acetate sulfate sulphate bisulfate phosphate citrate bromide".split()
#: First words after which ions stay.
LEADS = CATIONS + "ferrous ferric iron zinc lithium aluminum aluminium ammonium dimethyl".split()

#: Patterns, in Java's dialect.
DOSE = r"(?iU)\b\d+(\.\d+)?\s*(mg|mcg|ug|g|ml|iu|units?)?\b"
PUNCTUATION = r"[,/_\-+()\[\].*]"
SEVERITY = r"(?iU)\b(severe|mild|moderate|acute|chronic|extreme|slight|constant|intermittent|feeling|feeling of|sensation)\b"
DRUG_CUTOFF, EVENT_CUTOFF = 0.86, 0.9

#: Cells that mean "missing" in a delimited file.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
