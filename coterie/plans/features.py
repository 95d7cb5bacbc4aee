"""The names of the features in the two blocks."""

TABULAR = (
    "amount log_amount hour_of_day day_of_week account_age_days is_micro_ticket amount_z_vs_customer seconds_since_prev_customer seconds_since_prev_device prior_customer_payments prior_customer_failures prior_customer_failure_rate prior_customer_refunds prior_customer_refund_rate "
    "prior_distinct_cards_customer prior_distinct_devices_customer prior_distinct_cards_device prior_distinct_customers_device prior_distinct_customers_address new_cards_on_device_24h new_cards_on_device_7d "
    "vel_customer_1h vel_customer_24h vel_customer_7d vel_device_1h vel_device_24h vel_device_7d vel_card_1h vel_card_24h vel_ip_1h vel_ip_24h vel_addr_24h vel_addr_7d"
).split()
GRAPH = (
    "g_degree g_weighted_degree g_max_edge_weight g_mean_edge_weight size edges density mean_edge_weight max_edge_weight cl_payments cl_customers cl_distinct_cards cl_distinct_devices cl_distinct_addresses cl_distinct_ips cl_failure_rate cl_amount_mean cl_amount_median cl_amount_cv cl_account_age_mean cl_account_age_min "
    "cl_active_days cl_day_span cl_last_seen_lag cl_cards_per_device cl_customers_per_address cl_payments_per_active_day cl_burstiness cl_ring_risk cl_distinct_issuers cl_new_account_share cl_signup_std cl_signup_span cl_first_seen_std cl_first_seen_span cl_signup_synchrony cl_first_seen_synchrony cl_signup_span_per_customer cl_issuers_per_customer "
    "clsig_cohesion clsig_scale clsig_card_fanout clsig_decline clsig_fresh clsig_address_concentration clsig_burst clsig_cohort_synchrony clsig_new_accounts g_in_cluster g_snapshot_lag g_match"
).split()
