"""Schemas of the tables that readers give. Only a map's bins keep the columns of their files, whatever they are."""

CHROMS = "chrom string, length bigint"
RAW = "dataset string, chrom string, bin1 bigint, bin2 bigint, count double"
LOOPS = "chrom1 string, start1 bigint, end1 bigint, chrom2 string, start2 bigint, end2 bigint"
DATASETS = "res bigint, label string, uri string"
