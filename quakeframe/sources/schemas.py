"""Declared schemas; nothing is inferred."""

SEGMENTS = "net string, sta string, loc string, cha string, start timestamp, sr double, samples array<float>, chunk_id string"
TRIAL_JSONL = (
    "kind string, backend string, dtype string, backend_extra struct<compile: boolean>, model_parent string, model_child string, model_label string, device string, "
    "n_stations int, batch_size int, overlap_samples int, n_cpu_workers int, n_cpu_workers_per_gpu int, infer_num_threads int, repeat int, wall_time_s double, total_s double, "
    "stage_times_s map<string,double>, throughput_stations_per_s double, throughput_windows_per_s double, throughput_samples_per_s double, gpu_forward_s double, gpu_idle_s double, "
    "preprocess_total_s double, gpu_utilization_pct double, peak_gpu_mem_bytes bigint, benchmark_status string, error string"
)
REPEAT = (
    "struct<repeat_index: int, success: boolean, framework_init_s: double, model_load_s: double, waveform_access_s: double, preprocess_s: double, warmup_s: double, inference_s: double, "
    "pick_generation_s: double, total_s: double, n_windows: int, batch_size: int, dtype: string, packaging: string>"
)
RESULT_JSON = (
    f"schema_version int, recorded_at string, meta map<string,string>, timing struct<n_repeats: int, success_rate: double, repeats: array<{REPEAT}>>, memory map<string,double>, "
    "resources map<string,double>, pick_quality_vs_catalog struct<P: map<string,double>, S: map<string,double>>"
)
STATION = "struct<dataset: string, source_trace_row: int, p_sample: double, s_sample: double, p: array<double>, s: array<double>, sampling_rate: double, npts: int, t0: string>"
MANIFEST = f"meta struct<dataset: string, n_stations: int, t0: string, start_time: string, end_time: string, timechunk_dt: int, target_sampling_rate: double, match_tolerance_samples: int>, stations map<string,{STATION}>"
PICKS_JSON = "map<string,struct<p:array<double>,s:array<double>>>"
#: The eleven columns of a pick file, in order.  Fixed values.
PICK_COLUMNS = ("file_name", "network", "station", "instrument_type", "station_lat", "station_lon", "station_elv", "p_arrival_time", "p_probability", "s_arrival_time", "s_probability")
PICK_CSV = ", ".join(f"{c} string" for c in PICK_COLUMNS)
