"""Hand-made raw records: two pages in train, one in dev, one in test."""

import copy
import json

QUARTERLY = {
    "filename": "ABC/2014/page_64.pdf",
    "pre_text": ["more boats sailed in 2014 .", "daily takings follow ."],
    "post_text": ["the fleet bought 2,600 nets ."],
    "table": [["2014", "best", " "], ["spring", "$ 71.25", "$ 63.50"], ["2013", "best", "worst"],
              ["spring ", "$ 22.40", "$ 19.75"], ["share ", " 37.5% "], ["only label"]],
}
PLAIN = {"filename": "DEF/2015/page_10.pdf", "pre_text": ["no table here ."], "post_text": None, "table": []}


def record(page, number, question, answer, program, exe_ans, gold, steps=1):
    rec = copy.deepcopy(page)
    rec["id"] = f"{page['filename']}-{number}"
    rec["table_ori"] = [["dropped by the schema"]]
    rec["qa"] = {"question": question, "answer": answer, "program": program, "exe_ans": exe_ans,
                 "steps": [{"op": "x"}] * steps, "explanation": ""}
    if gold is not None:
        rec["qa"]["gold_inds"] = {g: "..." for g in gold}
    return rec


FILES = {
    "train": [
        record(QUARTERLY, 1, "by how much did takings rise ?", "26.1%",
               "subtract(7.25, 5.75), divide(#0, 5.75)", 0.26087, ["table_4", "text_0"], 2),
        record(QUARTERLY, 2, "best takings in spring ?", "48.9",
               "table_max(spring, none)", 22.4, ["table_3"]),
        record(PLAIN, 1, "was it larger ?", "yes", "greater(8, 6)", "yes", ["text_0"]),
    ],
    "dev": [record({**PLAIN, "filename": "GHI/1999/page_1.pdf"}, 1, "tiny ?", "n/a", "divide(2, 100000)", 2e-05, None)],
    "test": [record({**QUARTERLY, "filename": "JKL/x/page_2.pdf"}, 1, "total ?", "9%", "add(0.09, 0.00198)",
                    0.09198, ["text_1"])],
}


def write_files(folder, files=FILES):
    for split, records in files.items():
        (folder / f"{split}.json").write_text(json.dumps(records))
    return str(folder)
