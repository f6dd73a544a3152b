"""Golden sample tables (FIXTURES.md F1–F7) and the column policy of SURVEY §1.1."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

F1_SCHEMA = (
    "timestamp timestamp_ntz, flight_id string, aircraft_type string, altitude_feet int, latitude double, "
    "longitude double, vertical_speed int, squawk_code string, ground_speed int, track int, callsign string, "
    "speed_knots double, heading_degrees double"
)
F1_ROWS = [
    (datetime(2024, 1, 15, 10, 30), "FL001", "Boeing 737", 35000, 40.7128, -74.0060, 0, "1200", 450, 90, "UAL123", 450.5, 90.2),
    (datetime(2024, 1, 15, 10, 31), "FL002", "Airbus A320", 32000, 40.7500, -73.9800, 500, "2000", 420, 85, "DAL456", 420.8, 85.7),
    (datetime(2024, 1, 15, 10, 32), "FL003", "Boeing 777", 38000, 40.6892, -74.0445, -200, "1000", 480, 95, "AAL789", 480.2, 95.1),
    (datetime(2024, 1, 15, 10, 33), "FL004", "Embraer E190", 28000, 40.7589, -73.9851, 800, "3000", 380, 75, "JBU321", 380.9, 75.4),
    (datetime(2024, 1, 15, 10, 34), "FL005", "Boeing 787", 41000, 40.6782, -74.0298, 0, "1200", 520, 100, "SWA654", 520.1, 100.3),
]

F2_SCHEMA = (
    "waypoint_id string, waypoint_name string, latitude double, longitude double, altitude_feet int, "
    "waypoint_type string, country_code string, region string, frequency_mhz double, magnetic_variation double"
)
F2_ROWS = [
    ("WP001", "KENNEDY", 40.6413, -73.7781, 13, "VOR", "US", "NY", 115.9, -13.2),
    ("WP002", "LAGUARDIA", 40.7769, -73.8740, 21, "ILS", "US", "NY", 110.3, -13.1),
    ("WP003", "NEWARK", 40.6895, -74.1745, 9, "VOR", "US", "NJ", 108.4, -12.8),
    ("WP004", "TETERBORO", 40.8501, -74.0606, 9, "NDB", "US", "NJ", 0.0, -12.9),
    ("WP005", "WESTCHESTER", 41.0669, -73.7076, 439, "GPS", "US", "NY", 0.0, -13.3),
    ("WP006", "BRIDGEPORT", 41.1637, -73.1261, 9, "VOR", "US", "CT", 108.8, -14.1),
    ("WP007", "ISLIP", 40.7952, -73.1002, 99, "ILS", "US", "NY", 109.5, -13.8),
    ("WP008", "MONTAUK", 41.0761, -71.9581, 6, "NDB", "US", "NY", 0.0, -14.5),
    ("WP009", "BLOCK_ISLAND", 41.1681, -71.5804, 108, "GPS", "US", "RI", 0.0, -14.8),
    ("WP010", "PROVIDENCE", 41.7240, -71.4128, 55, "VOR", "US", "RI", 116.1, -15.2),
]

F3_SCHEMA = (
    "route_id string, route_name string, origin_airport string, destination_airport string, distance_nm int, "
    "estimated_time_minutes int, route_type string, altitude_profile string, fuel_consumption_gallons int, "
    "weather_dependency string"
)
F4_SCHEMA = (
    "observation_id string, airport_code string, observation_time timestamp_ntz, temperature_celsius double, "
    "humidity_percent int, wind_speed_knots int, wind_direction_degrees int, visibility_miles double, "
    "cloud_coverage string, barometric_pressure_hpa double"
)
F5_SCHEMA = (
    "forecast_id string, airport_code string, forecast_time timestamp_ntz, valid_time timestamp_ntz, "
    "predicted_temp_celsius double, predicted_wind_speed_knots int, predicted_wind_direction_degrees int, "
    "precipitation_probability_percent int, forecast_confidence string, severe_weather_risk string"
)
F6_SCHEMA = (
    "control_id string, sector_name string, controller_callsign string, frequency_mhz double, active_flights int, "
    "traffic_density string, weather_impact string, delay_minutes int, coordination_required boolean, "
    "emergency_status string"
)
F7_SCHEMA = (
    "operation_id string, airport_code string, runway_id string, operation_type string, aircraft_type string, "
    "operation_time timestamp_ntz, flight_number string, gate_assignment string, taxi_time_minutes int, "
    "fuel_consumed_gallons int"
)

# SURVEY §1.1: restricted role and hidden columns per table.
POLICY = {
    "flightradar_db.radar_detections": ("FlightRadarViewer", ("speed_knots", "heading_degrees")),
    "aeronav_db.navigation_waypoints": ("AeroNav", ("frequency_mhz", "magnetic_variation")),
    "aeronav_db.flight_routes": ("AeroNav", ("fuel_consumption_gallons", "altitude_profile")),
    "aeroweather_db.weather_observations": ("AeroWeather", ("barometric_pressure_hpa", "wind_speed_knots", "wind_direction_degrees")),
    "aeroweather_db.weather_forecasts": ("AeroWeather", ("predicted_wind_speed_knots", "predicted_wind_direction_degrees", "forecast_confidence")),
    "aerotraffic_db.air_traffic_control": ("AeroTraffic", ("frequency_mhz", "coordination_required", "emergency_status")),
    "aerotraffic_db.runway_operations": ("AeroTraffic", ("fuel_consumed_gallons", "taxi_time_minutes")),
}
EXPECTED_VISIBLE = {
    "flightradar_db.radar_detections": (11, 13),
    "aeronav_db.navigation_waypoints": (8, 10),
    "aeronav_db.flight_routes": (8, 10),
    "aeroweather_db.weather_observations": (7, 10),
    "aeroweather_db.weather_forecasts": (7, 10),
    "aerotraffic_db.air_traffic_control": (7, 10),
    "aerotraffic_db.runway_operations": (8, 10),
}
SCHEMAS = {
    "flightradar_db.radar_detections": F1_SCHEMA,
    "aeronav_db.navigation_waypoints": F2_SCHEMA,
    "aeronav_db.flight_routes": F3_SCHEMA,
    "aeroweather_db.weather_observations": F4_SCHEMA,
    "aeroweather_db.weather_forecasts": F5_SCHEMA,
    "aerotraffic_db.air_traffic_control": F6_SCHEMA,
    "aerotraffic_db.runway_operations": F7_SCHEMA,
}


def fixture_tables(spark: SparkSession) -> dict[str, DataFrame]:
    out = {}
    for name, schema in SCHEMAS.items():
        rows = {"flightradar_db.radar_detections": F1_ROWS, "aeronav_db.navigation_waypoints": F2_ROWS}.get(name, [])
        out[name] = spark.createDataFrame(rows, schema)
    return out


def policy_rows(tables: dict[str, DataFrame], conflict: bool = False):
    """Grant rows: DataScientist full on all 7; each restricted role its column list (all − hidden)."""
    rows = []
    for name in tables:
        db, t = name.split(".")
        rows.append(("DataScientist", db, t, None, ["SELECT"]))
        rows.append(("DataScientist", db, None, None, ["DESCRIBE"]))
        role, hidden = POLICY[name]
        cols = [c for c in tables[name].columns if c not in hidden]
        rows.append((role, db, t, cols, ["SELECT"]))
        rows.append((role, db, None, None, ["DESCRIBE"]))
    if conflict:
        rows.append(("FlightRadarViewer", "flightradar_db", "radar_detections", None, ["SELECT"]))
    return rows
