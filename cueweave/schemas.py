"""Declared schemas of the working tables."""

WORDS = "rec_id long, ord long, word string, start double, end double, speaker string, overlap_candidate boolean"
SEGMENTS = "rec_id long, seg_ord long, speaker string, start double, end double, text string, overlap_candidate boolean"
DECISIONS = "rec_id long, seg_ord long, start double, end double, decision string, reason string"
RANGES = "rec_id long, range_ord long, start double, end double"
RECORDINGS = "rec_id long, duration double"
JSON3 = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>>"
PROBE = (
    "struct<format:struct<duration:string>,streams:array<struct<codec_type:string,duration:string,"
    "duration_ts:string,time_base:string,tags:map<string,string>>>>"
)
ALIGNED = "segments array<struct<words:array<struct<word:string,start:double,end:double,speaker:string>>>>"
JUDGMENTS = "array<struct<start:string,end:string,decision:string,reason:string>>"
TRACKS = "array<struct<lang:string,entries:array<struct<ext:string,url:string>>>>"
EXPORT = "array<struct<start:double,end:double>>"
