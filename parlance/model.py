"""The tables that everything here works on.

A corpus is a table of turns, one row for each utterance, keyed by (file, utt_idx): utt_idx counts from
1 within a file and before any filter. Operators take such a table and read only the columns they name,
so a scan of Parquet reads no more. Columns beyond the first four may be missing where no operator asks.
"""

WORD = "struct<raw:string,cleaned:string,category:string,untranscribed:string,in_retrace:boolean,retrace_kind:string,replaced:boolean,replacement:boolean,n_err:int>"
MORPH = "struct<pos:string,lemma:string,features:array<string>>"
TURNS = f"""file string, utt_idx bigint, speaker string, cw array<string>,
    line_no int, text string, terminator string, linkers array<string>, postcodes array<string>,
    start_ms bigint, end_ms bigint, active_gems array<string>, tiers array<struct<label:string,content:string>>,
    words array<{WORD}>, mor array<struct<main:{MORPH},post_clitics:array<{MORPH}>>>,
    gra array<struct<idx:int,head:int,relation:string>>, cod array<string>, pho array<string>, mod array<string>"""
HEADERS = "file string, line_no int, kind string, participant string, value string"
IDS = "file string, speaker string, language string, corpus string, age string, sex string, grp string, ses string, role string, education string, custom string, id_raw string"
NORMS = "path string, language string, corpus string, speaker_code string, age_months int, sex string, grp string, ses string, role string, education string, custom string, scores array<double>"

#: Key and order of utterances.
KEY = ("file", "utt_idx")
