"""Schemas of the files and tables that operators read and write, as Spark DDL."""

from __future__ import annotations

BOX = "STRUCT<x1:DOUBLE,y1:DOUBLE,x2:DOUBLE,y2:DOUBLE>"
BOX_THOUSANDTHS = "STRUCT<x1:INT,y1:INT,x2:INT,y2:INT>"

DETECTION = f"STRUCT<class_id:INT,class_name:STRING,confidence:DOUBLE,bbox:{BOX}>"
PAGE = f"STRUCT<page_number:INT,image_path:STRING,image_size:STRUCT<width:INT,height:INT>,num_detections:INT,detections:ARRAY<{DETECTION}>>"
STATISTICS = "STRUCT<total_detections:INT,by_class:MAP<STRING,INT>,by_page:MAP<STRING,INT>,average_confidence_by_class:MAP<STRING,DOUBLE>,average_detections_per_page:DOUBLE>"
RESULT = f"pdf_name STRING, total_pages INT, model STRING, processed_at STRING, processing_time_seconds DOUBLE, pages ARRAY<{PAGE}>, statistics {STATISTICS}"

ITEM = f"STRUCT<item_id:STRING,item_type:STRING,page_number:INT,item_bbox:{BOX},caption_text:STRING,image_path:STRING,caption_bbox:{BOX}>"
EXTRACTION = f"pdf_name STRING, total_pages INT, statistics STRUCT<total_figures:INT,figures_with_captions:INT,total_tables:INT,tables_with_captions:INT>, figures ARRAY<{ITEM}>, tables ARRAY<{ITEM}>"

MATCH = f"STRUCT<figure_id:STRING,figure_type:STRING,figure_bbox:{BOX},caption_id:STRING,caption_bbox:{BOX},caption_text:STRING,confidence:DOUBLE,reasoning:STRING>"
ANNOTATED_PAGE = f"STRUCT<page_number:INT,matches:ARRAY<{MATCH}>,unmatched_figures:ARRAY<STRING>,unmatched_tables:ARRAY<STRING>,unmatched_captions:ARRAY<STRING>,annotated_image_path:STRING>"
ANNOTATION = f"pdf_name STRING, total_pages INT, annotator STRING, created_at STRING, pages ARRAY<{ANNOTATED_PAGE}>"

ELEMENT = f"STRUCT<id:INT,type:STRING,description:STRING,text:STRING,bbox:{BOX_THOUSANDTHS}>"
MODEL_MATCH = "STRUCT<figure_id:INT,figure_type:STRING,caption_id:INT,confidence:DOUBLE,reasoning:STRING>"
RESPONSE = f"STRUCT<elements:ARRAY<{ELEMENT}>,matches:ARRAY<{MODEL_MATCH}>,unmatched_figures:ARRAY<INT>,unmatched_tables:ARRAY<INT>,unmatched_captions:ARRAY<INT>>"

MANIFEST = "name STRING, version STRING, annotator STRING, created_at STRING, documents ARRAY<STRUCT<name:STRING,annotation_path:STRING,extraction_path:STRING>>"
METRICS = "STRUCT<precision:DOUBLE,recall:DOUBLE,f1:DOUBLE>"
REPORT = f"dataset STRUCT<name:STRING,version:STRING,total_documents:INT,successful_evaluations:INT>, summary {METRICS}, per_type_metrics STRUCT<figure:{METRICS},table:{METRICS}>, detailed_counts STRUCT<true_positives:INT,false_positives:INT,false_negatives:INT>, evaluator_config MAP<STRING,STRING>, created_at STRING"
