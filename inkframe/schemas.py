"""Table layouts that the operators read and write."""




BOX = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"
IMAGES = "image_id bigint, name string, height int, width int, bytes binary"
PIXELS = "image_id bigint, x bigint, y bigint, b bigint, g bigint, r bigint"
MASK = "image_id bigint, x bigint, y bigint, v int"
DETECTIONS = "image_id bigint, det_id bigint, detector string, detector_rank int, x bigint, y bigint, w bigint, h bigint, conf double"
POLYGONS = "image_id bigint, det_id bigint, geometry array<struct<x:float,y:float>>, confidence double"
REGIONS = "image_id bigint, region_id int, x bigint, y bigint, w bigint, h bigint, confidence double, detectors array<string>, detector_count int, original_confidences array<double>"
COMPONENTS = "image_id bigint, label bigint, area double, cx double, cy double, min_x bigint, max_x bigint, min_y bigint, max_y bigint"
TIMINGS = "image_name string, load_time double, detection_time double, color_time double, mask_time double, inpaint_time double, total_time double, image_mp double, consensus_boxes_count int, total_bbox_area bigint, failover_type string"
ERRORS = "image_id bigint, stage string, message string"
