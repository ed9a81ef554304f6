"""Schemas of the record model."""

#: One sequence record; ``qual`` is null for FASTA. (file_idx, pos) is the total order.
RECORD = "file string, file_idx int, pos long, id string, `desc` string, name string, seq string, qual string"
BED = "chrom string, start int, end int, name string, strand string"
GTF = "seqname string, source string, feature string, start int, end int, score string, strand string, frame string, attributes map<string,string>"
ALN = "read string, ref string, ref_len int, pos int, mapq int, flags int, cigar array<struct<op:string,len:int>>, seq string, qual array<int>, tags map<string,string>"
