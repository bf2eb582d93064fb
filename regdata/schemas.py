"""Explicit schema per dataset, with the checks a refresh applies. Fixed values."""

from __future__ import annotations

from pyspark.sql.types import StructType

DDL = {
    "overflow_2011": """
        Latitude double, Longitude double, Nearest_Pipe_Address string, Municipality string, DischargesBody string,
        `2011_Discharges_MGal` string, `2011_Discharge_N` string, Notes string""",
    "overflow_incident": """
        incidentId string, incidentNumber long, incidentDate timestamp_ntz, incidentTime string, amPm string, reporterClass string,
        eventType string, permiteeClass string, permiteeName string, permiteeId string, outfallId string, municipality string,
        reportingType string, location string, latitude double, longitude double, waterBody string, waterBodyDescription string,
        volumnOfEvent double, rainfallData double, hours double, minutes double, month double, additionalInformation string,
        submittedDate timestamp_ntz, parentIncidentId string, Year int""",
    "outfall_lookup": "`Outfall ID` string, Lat double, Long double",
    "block_group": "ID string, ACSTOTPOP double, MINORPCT double, LOWINCPCT double, LINGISOPCT double, STATE_NAME string",
    "enforcement_text": "Year int, Date string, Text string, Fine double, municipality string",
    "staff": """
        CalendarYear int, EmployeeName string, JobTitle string, Earnings double, JobType string, JobLevel string, Seniority int,
        name_first string, name_middleI string, name_last string""",
    "payroll": """
        bargaining_group_title string, contract string, department_division string, department_location_zip_code string,
        name_first string, name_last string, pay_base_actual double, pay_buyout_actual double, pay_overtime_actual double,
        pay_total_actual double, position_title string, position_type string, year int""",
    "budget_summary": """
        FiscalYear string, TotalBudget_inf string, TotalBudget_noinf string, Year int, GovernorsBudget int,
        DEPAdministration_inf string, DEPAdministration_noinf string, TotalBudget_inf_float double, TotalBudget_noinf_float double,
        DEPAdministration_inf_float double, DEPAdministration_noinf_float double""",
    "budget_history": "State string, BudgetDetail string, Year string, value string",
    "town_census": "population_acs52014 double, per_capita_income_acs52014 double, Subdivision string",
    "wage_index": """
        Year int, AWI double, Increase string, `Prior year average amount` string, `Average amount` double,
        `Number of workers` long, `Aggregate wages` long""",
    "facility": """
        Id long, StreetName string, Town string, FacilityType string, FacilityName string, Program string,
        ProgramSpecificId string, Active boolean""",
    "permit": """
        Id string, FacilityName string, PermitNumber string, PermitType string, Subtype string, Program string, StreetName string,
        Town string, Status string, FacilityId long, FinalDecisionDate timestamp_ntz, DateApplied timestamp_ntz""",
    "inspection": """
        Id long, Town string, Program string, FacilityId long, FacilityName string, InspectionType string,
        InspectionDate timestamp_ntz""",
    "enforcement": """
        Id long, Town string, Program string, EnforcementType string, PenaltyAssessed double, FacilityId long,
        FacilityName string, EnforcementDate timestamp_ntz""",
    "drinking_water": """
        ChemicalName string, Class string, CollectedDate timestamp_ntz, ContaminantGroup string, Id long, LocationName string,
        PWSId string, PWSName string, RaworFinished string, Result string, Town string""",
    "federal_permit": "State string, Stage string, Facility_Name string, Permit_Number string, Permit_URL string, Watershed string",
}


def schema_of(dataset: str) -> StructType:
    """Typed schema of a dataset (needs a running session)."""
    return StructType.fromDDL(DDL[dataset])


# Columns a dataset must have; extra ones are fine. Fixed values.
REQUIRED = {
    "federal_permit": ["State", "Stage", "Facility_Name", "Permit_Number"],
    "enforcement_text": ["Year"],
    "staff": ["CalendarYear"],
    "payroll": ["year"],
    "permit": ["FacilityName", "PermitNumber", "PermitType"],
    "facility": ["FacilityName", "FacilityType", "Town"],
    "inspection": ["FacilityName", "InspectionDate", "InspectionType"],
    "enforcement": ["FacilityName", "EnforcementDate", "EnforcementType"],
    "overflow_incident": ["incidentId", "incidentDate"],
}

# Fewest rows a dataset may have; 1 where none is given. Fixed values.
FLOORS = {
    "federal_permit": 500, "permit": 1000, "facility": 1000, "inspection": 1000, "enforcement": 100, "overflow_incident": 100,
}
